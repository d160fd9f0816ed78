"""Sessions by keyed state: equal to the batch job, over late rows, restarts and many batches."""
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.streaming import sessions as Z
from veilspark.streaming import streams as W

SCHEMA = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.StringType()), T.StructField("n", T.IntegerType())])


START = 28_000_000  # minutes; a stream's watermark begins at zero


def add(spark, folder, rows):
    """One file of rows (minute, user)."""
    df = spark.createDataFrame([((START + m) * 60.0, u, 1) for m, u in rows], "s double, user_id string, n int")
    df.select(F.timestamp_seconds("s").alias("ts"), "user_id", "n").coalesce(1).write.mode("append").parquet(folder)


def updates_of(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return Z.session_updates(stream)


def result(spark, folder, out):
    rows = Z.read_sessions(updates_of(spark, folder), out).collect()
    return {(r.user_id, int(r.session_start.timestamp() // 60) - START, int(r.session_end.timestamp() // 60) - START, r.entries, r.closed) for r in rows}


def test_add_entry_equals_sorting():
    rng = random.Random(1)
    for _ in range(200):
        times = [rng.randint(0, 60) for _ in range(rng.randint(0, 25))]
        sessions = []
        for t in times:
            Z.add_entry(sessions, t, 5)
        want = []
        for t in sorted(times):
            if want and t < want[-1][1] + 5:
                want[-1] = (want[-1][0], t, want[-1][2] + 1)
            else:
                want.append((t, t, 1))
        assert sessions == want


def test_late_rows_merges_closing_and_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        query = Z.start_sessions(updates_of(spark, folder), out, state)
        query.awaitTermination()
        return query

    add(spark, folder, [(0, "a"), (10, "a"), (100, "a"), (5, "b")])
    run()
    # the watermark is at 90: both sessions before it are over, the one from 100 on is not
    assert result(spark, folder, out) == {("a", 0, 40, 2, True), ("a", 100, 130, 1, False), ("b", 5, 35, 1, True)}
    # the stream starts again from its checkpoint: a row behind the watermark goes, a late one before it joins
    add(spark, folder, [(20, "a"), (92, "a"), (120, "a"), (150, "c"), (101, "c")])
    run()
    assert result(spark, folder, out) == {
        ("a", 0, 40, 2, True), ("b", 5, 35, 1, True), ("a", 92, 150, 3, False), ("c", 101, 131, 1, True), ("c", 150, 180, 1, False)}
    # the watermark is at 140: 145 is on time, and pulls the start of the open session of c forward
    add(spark, folder, [(170, "c"), (145, "c"), (400, "d")])
    query = run()
    got = result(spark, folder, out)
    assert {x for x in got if x[0] == "c"} == {("c", 101, 131, 1, True), ("c", 145, 200, 3, True)}
    assert ("a", 92, 150, 3, True) in got and ("d", 400, 430, 1, False) in got
    # state holds the open session only
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def test_a_row_that_links_two_open_sessions(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    add(spark, folder, [(0, "a"), (5, "b")])
    add(spark, folder, [(40, "b"), (9, "b"), (38, "a")])
    add(spark, folder, [(34, "b")])
    Z.start_sessions(updates_of(spark, folder), out, state).awaitTermination()
    # b: 5 to 9 and 40 are two sessions until 34 comes
    assert result(spark, folder, out) == {("a", 0, 30, 1, True), ("a", 38, 68, 1, False), ("b", 5, 70, 4, False)}


def test_equals_the_batch_job(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    want = {tuple(r) for r in W.stream_session_vault(events).collect()}
    stream = W.read_stream(spark, "/root/testdata/sf0.001", "events.parquet", spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema)
    got = Z.sessions_available(stream.select(F.col("ts").cast("timestamp").alias("ts"), "user_id"), "sessions")
    assert {tuple(r) for r in got.collect()} == want


def test_many_batches_cost_the_same(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(50):
        add(spark, folder, [(60 * k + j, f"u{(k + j) % 10}") for j in range(10)])
    query = Z.start_sessions(updates_of(spark, folder), out, state)
    query.awaitTermination()
    steps = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(steps) == 50
    # state does not grow: sessions of an hour ago are dropped
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in steps]
    assert max(rows[25:]) <= max(rows[:25])
    took = [p["batchDuration"] for p in steps]
    middle = lambda x: sorted(x)[len(x) // 2]
    assert middle(took[-15:]) <= 1.5 * middle(took[5:20])
    assert sum(x[3] for x in result(spark, folder, out)) == 500


def test_many_open_sessions_of_a_user_are_one_state(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    add(spark, folder, [(60 * k, "a") for k in range(40)])
    query = Z.start_sessions(updates_of(spark, folder), out, state)
    query.awaitTermination()
    first = next(p for p in query.recentProgress if p["numInputRows"])
    # all are open until the watermark moves: one value, and one timer in two tables
    assert first["stateOperators"][0]["numRowsTotal"] <= 4
    assert result(spark, folder, out) == {("a", 60 * k, 60 * k + 30, 1, k < 39) for k in range(40)}
