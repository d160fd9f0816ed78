"""Stored sketches against the values themselves: ranks within the stated error, counts and ends exact."""
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from veilspark.operators import sketches as S
from veilspark.session import write_through

SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def events(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    return e.select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"))


@pytest.mark.parametrize("days", [1, 5, 400])
def test_any_span_from_stored_sketches(spark, days):
    calls = events(spark)
    stored = write_through(spark, S.sketch_calls(calls, ["event_type"]), "sketches")
    start = calls.agg(F.date_trunc("DAY", F.min("ts"))).first()[0]
    end = F.lit(start) + F.expr(f"INTERVAL {days} DAYS")
    got = S.read_sketches(S.merge_sketches(stored, ["event_type"], F.lit(start), end), ["event_type"], SHARES).collect()
    inside = calls.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < end) & F.col("latency_ms").isNotNull())
    exact = {r.event_type: sorted(r.v) for r in inside.groupBy("event_type").agg(F.collect_list("latency_ms").alias("v")).collect()}
    assert {r.event_type for r in got} == exact.keys() and exact
    for r in got:
        values = exact[r.event_type]
        assert (r.n, r.min, r["max"]) == (len(values), values[0], values[-1])
        for name, share in SHARES.items():
            low, high = bisect_left(values, r[name]) / len(values), bisect_right(values, r[name]) / len(values)
            # three times the error of 99 in 100, and one value
            slack = 3 * S.rank_error() + 1 / len(values)
            assert low - slack <= share <= high + slack, (r.event_type, name)


def test_late_calls_nulls_and_empty(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 3.0), ("a", "2024-01-01 01:10:00", 9.0), ("b", None, 1.0), ("b", "2024-01-01 01:10:00", None)]
    calls = spark.createDataFrame(rows, "g string, t string, latency_ms double").select("g", F.col("t").cast("timestamp").alias("ts"), "latency_ms")
    sketches = S.sketch_calls(calls, ["g"])
    late = S.sketch_calls(spark.createDataFrame([("a", 2.0)], "g string, latency_ms double").withColumn("ts", F.lit("2024-01-01 00:59:00").cast("timestamp")), ["g"])
    got = S.read_sketches(S.merge_sketches(sketches.unionByName(late), ["g"], None, F.lit("2024-01-01 01:00:00").cast("timestamp")), ["g"], {"p50": 0.5}).collect()
    assert [(r.g, r.n, r.min, r.p50, r["max"]) for r in got] == [("a", 3, 1.0, 2.0, 3.0)]
    assert S.sketch_calls(calls.limit(0), ["g"]).count() == 0 and S.rank_error(200) == pytest.approx(0.0133, abs=1e-4)
