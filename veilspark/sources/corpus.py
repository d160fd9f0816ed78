"""Reading corpora and JSON lines; writing artifacts and the audit log."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators.files import file_format

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("redaction_count", T.IntegerType()),
        T.StructField("method", T.StringType()),
    ]
)


def load_corpus(
    spark: SparkSession, root: str, glob: str | None = None, max_bytes: int | None = None, skip_unreadable: bool = False
) -> DataFrame:
    """(path, mtime, size_bytes, format, text), one row per file below `root`.

    Bytes that are no UTF-8 become the replacement character.  A file that vanishes or
    cannot be read stops the job, unless `skip_unreadable` allows to go on without it.
    `mtime` is in epoch milliseconds.  If a caller sets `max_bytes`, files above it come
    with a null text: their size is known from the listing, and their content is not read.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", str(skip_unreadable).lower())
        .option("ignoreCorruptFiles", str(skip_unreadable).lower())
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    about = [
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.unix_millis("modificationTime").alias("mtime"),
        F.col("length").alias("size_bytes"),
        file_format(F.col("path")).alias("format"),
    ]
    text = F.make_valid_utf8(F.col("content").cast("string"))
    if max_bytes is None:
        return files.select(*about, text.alias("text"))
    small = files.where(F.col("length") <= max_bytes).select(*about, text.alias("text"))
    large = files.where(F.col("length") > max_bytes).select(*about, F.lit(None).cast("string").alias("text"))
    return small.unionByName(large)


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, keep_bad: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Rows of JSON lines with a given schema; blank and malformed lines are left out.

    With `keep_bad` returns (rows, bad), where `bad` holds the raw malformed lines.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad_name = "_corrupt_record"
    full = T.StructType([*schema.fields, T.StructField(bad_name, T.StringType())])
    parsed = lines.select(
        "value", F.from_json("value", full, {"columnNameOfCorruptRecord": bad_name}).alias("_r")
    )
    is_bad = F.col("_r").isNull() | F.col(f"_r.{bad_name}").isNotNull()
    rows = parsed.where(~is_bad).select(*[F.col(f"_r.{name}") for name in schema.names])
    if not keep_bad:
        return rows
    return rows, parsed.where(is_bad).select(F.col("value").alias("line"))


def write_artifacts(artifacts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Artifacts as parquet in 256 shards by the first two digits of their key.

    With dynamic partition overwrite only the shards that are touched are
    replaced.  The rows are rebalanced by shard: adaptive execution gives a shard as many tasks
    and files as its size asks for.
    """
    sharded = artifacts.withColumn("shard", F.substring("cache_key", 1, 2))
    (
        sharded.hint("rebalance", "shard")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )


def write_audit(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events as JSON lines; the time of writing replaces any the caller gave."""
    stamped = events.withColumn("timestamp", F.current_timestamp())
    for field in AUDIT_SCHEMA.fields:
        if field.name not in stamped.columns:
            stamped = stamped.withColumn(field.name, F.lit(None).cast(field.dataType))
    stamped.select(*AUDIT_SCHEMA.names).write.mode(mode).json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, AUDIT_SCHEMA)
