"""Named queries: the streaming jobs, run over the given tables, and their batch twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators.redact import placeholder_rows, sanitize
from veilspark.plans import inputs as I
from veilspark.plans import sql_text as S
from veilspark.plans.catalog import query
from veilspark.plans.corpus import EGRESS_SQL
from veilspark.streaming import sessions as Z
from veilspark.streaming import streams as W

DOCS = "docs AS (SELECT doc_id, text FROM documents)"


def _stream(spark, sf, name):
    stream = W.read_stream(spark, sf, f"{name}.parquet", I.table(spark, sf, name).schema)
    # Watermarks need a timestamp with a zone; the stored ones are in UTC.
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else stream


@query("stream_sanitize", f"WITH {DOCS}, {S.sanitized_cte('docs')} SELECT doc_id, sanitized_text, redaction_count FROM sanitized")
def stream_sanitize(spark, sf):
    docs = _stream(spark, sf, "documents").select("doc_id", "text")
    return W.drain(W.stream_sanitize(docs), "sanitized").drop("method")


# The same few files are seen over and over.
@query("stream_dedupe", "SELECT DISTINCT '/u/' || user_id AS path, event_id % 3 AS mtime FROM events")
def stream_dedupe(spark, sf):
    seen = _stream(spark, sf, "events").select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"),
        (F.col("event_id") % 3).alias("mtime"),
        F.lit(1).alias("size_bytes"),
        "ts",
    )
    return W.drain(W.stream_dedupe(seen, "ts", "60 days"), "deduped").select("path", "mtime")


_ACTION = "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'sanitize' WHEN 'signup' THEN 'classify_safe' ELSE 'block' END"


def _actions(events):
    kind = F.col("event_type")
    action = (
        F.when(kind == "view", "read").when(kind == "click", "search").when(kind == "purchase", "sanitize")
        .when(kind == "signup", "classify_safe").otherwise("block")
    )
    return events.select("ts", "user_id", "event_id", action.alias("action"))


_WINDOW_SQL = f"""
WITH counted AS (SELECT date_trunc('hour', ts) AS w, {_ACTION} AS action, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, action, n FROM counted"""


def _as_text(df, *names):
    return df.select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in names else F.col(c) for c in df.columns]
    )


@query("stream_audit_counts", _WINDOW_SQL)
def stream_audit_counts(spark, sf):
    counts = W.stream_audit_counts(_actions(_stream(spark, sf, "events")))
    done = W.upsert_available(counts, "audit_counts", ["window_start", "window_end", "action"])
    return _as_text(done, "window_start", "window_end")


@query("batch_audit_counts", _WINDOW_SQL)
def batch_audit_counts(spark, sf):
    counts = W.stream_audit_counts(_actions(I.table(spark, sf, "events")))
    return _as_text(counts, "window_start", "window_end")


# Every event carries a message with one or two things to hide: its vault rows make the sessions.
_SESSION_SQL = """
WITH gaps AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM events),
s AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end,
       sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS entries
FROM s GROUP BY user_id, k"""


def _vault_rows(events):
    """(ts, user_id, category, placeholder) of what was hidden in each event's message."""
    mail = F.concat(F.lit("mail u"), F.col("user_id").cast("string"), F.lit("@example.com"))
    from_ip = F.concat(F.lit(" from 10.0.0."), (F.col("event_id") % 250 + 1).cast("string"))
    text = F.concat(mail, F.when(F.col("event_id") % 2 == 0, from_ip).otherwise(""))
    hidden = sanitize(events.select("ts", "user_id", "event_id", text.alias("text")))
    return placeholder_rows(hidden, ("ts", "user_id")).select("ts", "user_id", "category", "placeholder")


@query("stream_session_vault", _SESSION_SQL)
def stream_session_vault(spark, sf):
    sessions = Z.sessions_available(_vault_rows(_stream(spark, sf, "events")), "sessions")
    return _as_text(sessions, "session_start", "session_end")


@query("batch_session_vault", _SESSION_SQL)
def batch_session_vault(spark, sf):
    return _as_text(W.stream_session_vault(_vault_rows(I.table(spark, sf, "events"))), "session_start", "session_end")


@query("stream_egress_alerts", EGRESS_SQL)
def stream_egress_alerts(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 7
    extra = (
        F.when(kind == 0, " __EMAIL_1__").when(kind == 1, " sk-" + "a1" * 6)
        .when(kind == 2, " __SECRET_2__ AKIA" + "Z" * 16).when(kind == 3, " sk-short")
        .when(kind == 4, " xAKIA" + "Z" * 16).otherwise("")
    )
    talk = _stream(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", extra).alias("payload"))
    return W.drain(W.stream_egress_alerts(talk), "alerts").select("conv_id", "turn", "reason")
