"""A versioned store of artifacts: an upsert rewrites the shards its keys fall in, and commits or does nothing.

    <path>/data/<version>-<run>/shard=ab/part-*.parquet    rows, in shards by the first digits of their key
    <path>/versions/0000000012.json                        manifest: shard -> folder, and the schema

A version is its manifest, which is a few bytes per shard.  A writer reads the newest one, reads the touched
shards alone, writes them anew into a folder of its own, and renames its manifest to the next number, which fails if
there is one of that number already.  So a run that fails leaves the old version as it was, and of two writers
that began at the same version one commits and the other gets `VersionConflict`.  Readers keep the version they opened.

The rename is atomic on file systems with atomic renames that do not replace (HDFS); a local file system
checks and renames, one right after the other.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.session import broadcast_if_small, write_through

KEYS = ("cache_key", "ruleset_version")


class VersionConflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    """One committed state: its number, the schema of its rows, and the folder of every shard."""

    number: int
    schema: T.StructType
    shards: dict[str, str] = field(default_factory=dict)


class ArtifactStore:
    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    # --- versions -------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(path), self.spark._jsc.hadoopConfiguration()

    def _manifest(self, number: int) -> str:
        return f"{self.path}/versions/{number:010d}.json"

    def versions(self) -> list[int]:
        """The numbers of all committed versions, from a listing of their names."""
        folder, conf = self._hadoop(f"{self.path}/versions")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version, the newest by default; None if there is none."""
        if number is None:
            numbers = self.versions()
            if not numbers:
                return None
            number = numbers[-1]
        text = self.spark.read.text(self._manifest(number), wholetext=True).first().value
        read = json.loads(text)
        return Version(number, T.StructType.fromJson(read["schema"]), read["shards"])

    def _commit(self, version: Version) -> None:
        """Write the manifest under a name of its own and rename it; fails if its number is taken."""
        jvm = self.spark._jvm
        body = json.dumps({"schema": version.schema.jsonValue(), "shards": version.shards})
        draft, conf = self._hadoop(f"{self.path}/versions/.draft-{uuid.uuid4().hex}")
        final, _ = self._hadoop(self._manifest(version.number))
        out = draft.getFileSystem(conf).create(draft, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(conf).getUri(), conf)
        qualified = files.makeQualified
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(qualified(draft), qualified(final), none)
        except Exception as error:  # py4j wraps what the file system throws
            draft.getFileSystem(conf).delete(draft, False)
            if "AlreadyExists" in str(error):
                raise VersionConflict(f"version {version.number} of {self.path} was committed by another writer") from error
            raise

    # --- reading --------------------------------------------------------------------------------

    def shard(self, key: Column | str = "cache_key") -> Column:
        return F.substring(key, 1, self.digits)

    def read(self, version: Version | None = None, shards: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of some shards only, if they are given."""
        version = version or self.version()
        if version is None:
            raise FileNotFoundError(f"no version of {self.path}")
        wanted = version.shards if shards is None else {s: version.shards[s] for s in shards if s in version.shards}
        if not wanted:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*[f"{self.path}/{folder}" for _, folder in sorted(wanted.items())])

    def shards_of(self, rows: DataFrame) -> list[str]:
        """The shards that keys fall in: at most 16 ** digits short strings."""
        return sorted(r[0] for r in rows.select(self.shard().alias("shard")).distinct().collect() if r[0] is not None)

    def read_for(self, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows in the shards of some keys; no file of another shard is opened."""
        return self.read(version, self.shards_of(keys))

    # --- writing --------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, number: int) -> str:
        folder = f"data/{number:010d}-{uuid.uuid4().hex}"
        sharded = rows.withColumn("shard", self.shard())
        sharded.hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{self.path}/{folder}")
        return folder

    def create(self, rows: DataFrame) -> Version:
        """The first version."""
        rows = write_through(self.spark, rows, "artifacts")
        folder = self._write(rows, 1)
        version = Version(1, rows.schema, {s: f"{folder}/shard={s}" for s in self.shards_of(rows)})
        self._commit(version)
        return version

    def upsert(self, new: DataFrame, force: bool = False, keys: Sequence[str] = KEYS, retries: int = 0,
               before_commit: Callable[[], None] | None = None) -> Version:
        """Commit a version in which the newest artifact of each key stays; at the same instant, and with
        `force`, the new one.

        Which rows win is decided on keys and times alone.  Shards that no new row falls in are neither read
        nor written; the others are copied without the rows that lost.  After a conflict the upsert starts
        again from the newest version, up to `retries` times.  `before_commit` runs when all is written.
        """
        new = write_through(self.spark, new, "upsert")
        for attempt in range(retries + 1):
            base = self.version()
            if base is None:
                raise FileNotFoundError(f"no version of {self.path}; create one first")
            touched = self.shards_of(new)
            if not touched:
                return base
            merged = merge(self.read(base, touched), new.select(*base.schema.names), force, keys)
            number = base.number + 1
            folder = self._write(merged, number)
            shards = base.shards | {s: f"{folder}/shard={s}" for s in touched}
            if before_commit is not None:
                before_commit()
            try:
                version = Version(number, base.schema, shards)
                self._commit(version)
                return version
            except VersionConflict:
                if attempt == retries:
                    raise
        raise AssertionError("unreachable")

    def expire(self, keep: int = 2) -> list[str]:
        """Delete all versions but the newest `keep`, and the folders that none of these holds.

        Folders of a version newer than the newest manifest are left alone: a writer may be at work.
        """
        numbers = self.versions()
        kept = {n: self.version(n) for n in numbers[-keep:]}
        used = {folder.split("/")[1] for v in kept.values() for folder in v.shards.values()}
        data, conf = self._hadoop(f"{self.path}/data")
        fs, gone = data.getFileSystem(conf), []
        for status in fs.listStatus(data) if numbers else []:
            name = status.getPath().getName()
            if name not in used and int(name.split("-")[0]) <= numbers[-1]:
                fs.delete(status.getPath(), True)
                gone.append(name)
        for n in numbers[:-keep]:
            fs.delete(self._hadoop(self._manifest(n))[0], False)
        return gone


def merge(old: DataFrame, new: DataFrame, force: bool, keys: Sequence[str] = KEYS) -> DataFrame:
    """Old and new rows without those that lost to another one of their key.

    New rows are ranked among themselves.  Old ones are joined by key and time, narrow rows; the rows
    that lose, at most as many as there are new ones, are then taken out of both sides.
    """
    spark, names = old.sparkSession, old.columns
    best = new.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("cached_at").desc()))).where("_rank = 1").drop("_rank")
    best = write_through(spark, best, "fresh")
    narrow = best.select(*keys, F.col("cached_at").alias("_new_at"))
    both = old.select(*keys, "cached_at").join(broadcast_if_small(narrow), list(keys))
    wins = F.lit(True) if force else F.col("_new_at") >= F.coalesce("cached_at", "_new_at")
    decided = write_through(spark, both.select(*keys, F.coalesce(wins, F.lit(False)).alias("_new_wins")), "decided")
    beaten = lambda test: broadcast_if_small(write_through(spark, decided.where(test).select(*keys).distinct(), "beaten"))
    return old.join(beaten("_new_wins"), list(keys), "left_anti").select(*names).unionByName(
        best.join(beaten("not _new_wins"), list(keys), "left_anti").select(*names))
