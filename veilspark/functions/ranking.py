"""Exact ranks and percentiles that never put one group into one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.session import broadcast_if_small, write_through


def number_within(
    df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence[str | Column], out: str
) -> DataFrame:
    """`row_number()` from 1 per group, ordered by (chunk, *order).

    `chunk` must not decrease along the wanted order.  Rows are numbered inside
    (group, chunk); the sizes of a group's earlier chunks are added.  So a group
    that holds a third of the data is spread over as many tasks as it has chunks,
    and only one small row per chunk meets in the group's own window.

    The chunk sizes are counted in a pass of their own: give a table, not a costly
    computation, as `df`.  `group` columns must not be null.
    """
    keyed = df.withColumn("_chunk", chunk)
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*group, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    return (
        keyed.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*group, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_chunk", "_local", "_before")
    )


def number_sorted(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """`row_number()` from 1 per group along sortable columns of any type.

    One exchange by ranges of (group, order) puts the rows in order over all tasks; the ranges are
    sampled, so a group with most of the rows takes most of the tasks.  The ranges are
    stored with their number, so that every later pass sees the same ones.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    stored = write_through(df.sparkSession, ranged, "ranges")
    return number_within(stored, group, F.col("_range"), order, out).drop("_range")


def hash_chunk(digest: Column, digits: int = 4) -> Column:
    """Chunk of a hexadecimal digest: its first digits, uniform by nature."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


#: Rows of a range whose distinct values may meet in one task; a range with more is cut further.
ROWS_PER_RANGE = 100_000
PARTS = 4096


def values_at_ranks(
    df: DataFrame, group: Sequence[str], value: str, ranks: dict[str, Column], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """The values at given 1-based ranks of each group's sorted numbers.

    `ranks` maps output names to expressions over `n`, the group's row count.  Null values are
    ignored.  Exact, by narrowing ranges: a histogram over logarithmic buckets finds the range
    of values that holds each rank; ranges with many rows are cut into `PARTS` equal parts, and again,
    until each holds few rows or one value; then distinct values are counted inside them.
    Every pass reads `df` once and counts before the shuffle.  There are at most as many ranges as
    groups times ranks; they pick the rows of a pass, broadcast if they are few, so raw
    rows are not shuffled.  The passes run while the plan is built, as each depends on the one before.
    """
    group = list(group)
    spark = df.sparkSession
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(*group, x.alias("_x"))
    span = [*group, "_lo", "_hi"]
    counts = [F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_from"), F.max("_x").alias("_to")]

    def up_to(keys: Sequence[str], order: str) -> Column:
        return F.sum("_c").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

    holds = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c"))
    rest = (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")

    def within(ranges: DataFrame) -> DataFrame:
        picked = broadcast_if_small(write_through(spark, ranges.select(*span).distinct(), "ranges"))
        return rows.join(picked, group).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))

    bucket = (F.signum("_x") * F.floor(F.log2(F.abs("_x") + 1) * 256)).cast("long")
    histogram = (
        rows.groupBy(*group, bucket.alias("_b")).agg(*counts)
        .withColumn("_upto", up_to(group, "_b"))
        .withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("name"), v.cast("long").alias("rank")) for k, v in ranks.items()])
    )
    targets = (
        histogram.select("*", wanted.alias("_w"))
        .select("*", F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"))
        .where(holds)
        .select(*group, F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), "_name", "n", rest, "_c")
    )
    targets = write_through(spark, targets, "targets")
    while True:
        wide = targets.where((F.col("_lo") < F.col("_hi")) & (F.col("_c") > rows_per_range))
        if wide.isEmpty():
            break
        part = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1))
        cut = within(wide).groupBy(*span, part.alias("_b")).agg(*counts).withColumn("_upto", up_to(span, "_b"))
        narrowed = (
            wide.drop("_c").join(cut, span).where(holds)
            .select(*group, F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), "_name", "n", rest, "_c")
        )
        done = targets.where((F.col("_lo") >= F.col("_hi")) | (F.col("_c") <= rows_per_range))
        targets = write_through(spark, done.unionByName(narrowed), "targets")
    distinct = within(targets).groupBy(*span, "_x").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", up_to(span, "_x"))
    found = targets.drop("_c").join(distinct, span).where(holds)
    return found.groupBy(*group).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_name") == k, F.col("_x"))).alias(k) for k in ranks],
    )


def percentiles(
    df: DataFrame, group: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Exact percentiles with linear interpolation at (n - 1) * p, plus `n`."""
    ranks: dict[str, Column] = {}
    for name, p in points.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        ranks[f"_lo_{name}"] = F.floor(at) + 1
        ranks[f"_hi_{name}"] = F.ceil(at) + 1
    found = values_at_ranks(df, group, value, ranks)
    out = []
    for name, p in points.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*group, "n", *out)
