"""Sessions of vault entries as keyed state: a user's open sessions, and a timer that closes each.

A session lasts from its first entry to `gap` after its last one.  State holds the open sessions of a
user in one value, and an event-time timer at the time the first of them is due closes all that are over
once the watermark has passed.  So a user costs a few calls of the state store per micro-batch, however many sessions open and close,
state is bounded by what is open, and a micro-batch costs what its own rows and their users' open sessions cost.  Rows older than the watermark are dropped; every other late row
finds its session still open.

Every micro-batch sends the sessions it changed: opened or grown (`OPEN`), merged into an earlier one
(`WITHDRAWN`) or closed (`CLOSED`).  The last message about a session holds.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspark.session import scratch_path

WITHDRAWN, OPEN, CLOSED = 0, 1, 2
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def add_entry(sessions: list[tuple[int, int, int]], at: int, gap: int) -> None:
    """Put an entry into sorted, disjoint sessions (first entry, last entry, entries), joining those it links."""
    k = bisect_left(sessions, (at + gap,))
    first = k
    while first and sessions[first - 1][1] + gap > at:
        first -= 1
    linked = sessions[first:k]
    del sessions[first:k]
    insort(sessions, (min([at, *(s[0] for s in linked)]), max([at, *(s[1] for s in linked)]), 1 + sum(s[2] for s in linked)))


class SessionProcessor(StatefulProcessor):
    """Input rows (user, at: microseconds); output (user, start, last, entries, status)."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, lasts array<long>, entries array<long>, timer long")

    def _due(self, session: tuple[int, int, int]) -> int:
        """When a session is over, in milliseconds, rounded up."""
        return -(-(session[1] + self.gap) // 1000)

    def _row(self, key, session: tuple[int, int, int], status: int) -> Row:
        return Row(user=key[0], start=session[0], last=session[1], entries=session[2], status=status)

    def _read(self) -> tuple[list[tuple[int, int, int]], int | None]:
        """The open sessions, in order, and when the timer is set for."""
        state = self.open.get()
        return ([], None) if state is None else (list(zip(*state[:3])), state[3])

    def _keep(self, sessions: list[tuple[int, int, int]], timer: int | None) -> None:
        """Store the sessions, with one timer at the time the first of them is due."""
        due = self._due(sessions[0]) if sessions else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.open.clear()
            return
        self.open.update((*map(list, zip(*sessions)), due))
        if timer != due:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, timer = self._read()
        sessions = list(before)
        for row in rows:
            add_entry(sessions, row.at, self.gap)
        old, new = set(before), set(sessions)
        self._keep(sessions, timer)
        for s in sorted(new - old):
            yield self._row(key, s, OPEN)
        starts = {s[0] for s in new}
        for s in sorted(old - new):
            if s[0] not in starts:
                yield self._row(key, s, WITHDRAWN)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sessions, timer = self._read()
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        # sessions are sorted and disjoint, so they are due in order
        over = next((k for k, s in enumerate(sessions) if self._due(s) >= now and self._due(s) > at), len(sessions))
        if timer == at:
            timer = None  # it is over
        self._keep(sessions[over:], timer)
        for s in sessions[:over]:
            yield self._row(key, s, CLOSED)

    def close(self) -> None:
        pass


def _micros(spark, interval: str) -> int:
    return spark.range(1).select((F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {interval}"))).alias("m")).first().m


def session_updates(entries: DataFrame, event_time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, session_start, session_end, entries, status): what each micro-batch of a stream changes."""
    width = _micros(entries.sparkSession, gap)
    rows = entries.withWatermark(event_time, late).select(
        F.col(event_time).alias("ts"), F.col(user).alias("user"), F.unix_micros(event_time).alias("at"))
    out = T.StructType([T.StructField("user", entries.schema[user].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "last", "entries")],
                        T.StructField("status", T.IntegerType())])
    changed = rows.groupBy("user").transformWithState(SessionProcessor(width), out, "Append", "EventTime")
    return changed.select(
        F.col("user").alias(user), F.timestamp_micros("start").alias("session_start"), F.timestamp_micros(F.col("last") + width).alias("session_end"),
        "entries", "status")


def start_sessions(updates: DataFrame, out: str, checkpoint: str):
    """Start writing the updates of a stream below `out`, each micro-batch under its number, until the present
    input is worked off; a batch that is repeated after a failure replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    conf = updates.sparkSession.conf
    provider = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)  # the store that map state and timers need; read when the query starts
    try:
        return (updates.writeStream.foreachBatch(store).outputMode("append")
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if provider is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, provider)


def read_sessions(updates: DataFrame, out: str, user: str = "user_id") -> DataFrame:
    """(user, session_start, session_end, entries, closed): the last word on every session below `out`."""
    spark = updates.sparkSession
    schema = T.StructType([*updates.schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(out)
    last = rows.groupBy(user, "session_start").agg(
        F.max_by(F.struct("session_end", "entries", "status"), F.struct("_batch", "status")).alias("_r"))
    return last.where(F.col("_r.status") != WITHDRAWN).select(
        user, "session_start", "_r.session_end", "_r.entries", (F.col("_r.status") == CLOSED).alias("closed"))


def sessions_available(entries: DataFrame, name: str, event_time: str = "ts", user: str = "user_id", gap: str = "30 minutes",
                       late: str = "10 minutes") -> DataFrame:
    """Run a stream of entries over the present input; the sessions of every user, open ones too."""
    spark = entries.sparkSession
    out = scratch_path(spark, name)
    updates = session_updates(entries, event_time, user, gap, late)
    start_sessions(updates, out, scratch_path(spark, f"{name}-state")).awaitTermination()
    return read_sessions(updates, out, user).drop("closed")
