"""Session settings and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Planner settings the jobs assume.  Shuffle partitions are left to the cluster:
# adaptive execution merges small ones and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that is already running."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started from."""
    if spark.conf.get("veilspark.shipped", "") == spark.sparkContext.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="veilspark-package-"), "veilspark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("veilspark", os.path.relpath(path, here)))
    spark.addArtifacts(target, pyfile=True)
    spark.conf.set("veilspark.shipped", spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in `spark.checkpoint.dir`.

    Where none is set, a session on one machine (`local[...]`) gets a temporary folder; on a
    cluster that is an error, since executors would write where the others cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in this application's own folder below the shared one.

    All that a run leaves lies in that folder, which may go when the run has ended.
    """
    return f"{shared_folder(spark)}/veilspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession):
    """Within it, a write deletes its shuffle files when it ends, not when the driver collects its garbage.

    What was written is read from the shared folder, so nothing needs those files again.
    """
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


def write_through(spark: SparkSession, df, name: str):
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, so that a costly or order-sensitive input is computed once
    and survives lost executors.  Its shuffle files go when it is written.
    """
    path = scratch_path(spark, name)
    with _shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_parts(spark: SparkSession, parts, name: str):
    """Write frames of one schema, each made when the one before is written, as one frame and read it back."""
    path = scratch_path(spark, name)
    for df in parts:
        with _shuffles_go(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames) -> None:
    """Delete what `write_through` or `write_parts` wrote for these frames, which nothing will read again."""
    for df in frames:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows that may be broadcast; a frame with more is joined by a shuffle.  With the narrow rows
#: this is used for, a broadcast stays under about 64 MB.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df, rows: int = BROADCAST_ROWS):
    """A stored frame of narrow rows, marked for broadcast only if it was counted and is small."""
    return F.broadcast(df) if df.count() <= rows else df
