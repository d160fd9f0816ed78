"""Approximate percentiles from stored, mergeable sketches.

`evaluate.latency_percentiles` is exact and reads the calls of the span asked for.  Here each group and hour of
calls is summarised once, as a KLL quantile sketch of a few KB; the percentiles of any span of hours then come from
merging its sketches, without the calls.  A sketch of size `k` misses a rank by less than 2.3 / k ** 0.97 of
the number of values in 99 of 100 cases, merged or not: 0.35 % for the default of 800, 1.33 % for 200.  Number, least and greatest
value are exact.

Defined results: calls without a value or a time are left out; a group without calls has no sketch; sketches of
one group and hour that were stored at different times are merged like any others, so late calls are added by
storing their sketch as well.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 800


def rank_error(k: int = K) -> float:
    """The share of the values by which a rank may be missed, with 99 % confidence."""
    return 2.296 / k ** 0.9723


def sketch_calls(calls: DataFrame, group: Sequence[str], value: str = "latency_ms", time: str = "ts", span: str = "HOUR", k: int = K) -> DataFrame:
    """(group, span_start, sketch): one sketch per group and span; sketches are built before the shuffle."""
    used = calls.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    return used.groupBy(*group, F.date_trunc(span, F.col(time)).alias("span_start")).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merge_sketches(sketches: DataFrame, group: Sequence[str], start: Column | None = None, end: Column | None = None, k: int = K) -> DataFrame:
    """(group, sketch): the sketches of spans that start from `start` on and before `end`, as one per group."""
    if start is not None:
        sketches = sketches.where(F.col("span_start") >= start)
    if end is not None:
        sketches = sketches.where(F.col("span_start") < end)
    return sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def read_sketches(merged: DataFrame, group: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """(group, n, min, one column per share, max) of merged sketches."""
    at = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(float(share)))
    return merged.select(
        *group, F.kll_sketch_get_n_double("sketch").alias("n"), at(0).alias("min"), *[at(s).alias(name) for name, s in shares.items()], at(1).alias("max"))
