"""Do only what changed: cache split, upsert and the whole read flow."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.globs import cache_key
from veilspark.functions.patterns import DEFAULT_RULES, Rule
from veilspark.functions.spans import find_spans, merge_spans, number_spans, replace_spans
from veilspark.operators.files import file_format, image_reason, oversize_reason
from veilspark.operators.policy import path_policy
from veilspark.operators.redact import METHOD_REGEX
from veilspark.operators.verdict import audit_action, evidence_verdict, review_message
from veilspark.session import broadcast_if_small, write_through

LAYOUT_NAMESPACE = "pdf-redact:"  # fixed value
RULESET = "default-1"


def with_cache_key(files: DataFrame, namespace: str = "") -> DataFrame:
    """Adds `cache_key` from (path, mtime, size_bytes)."""
    return files.withColumn(
        "cache_key", cache_key(F.col("path"), F.col("mtime"), F.col("size_bytes"), namespace)
    )


def cache_split(
    files: DataFrame, artifacts: DataFrame, ruleset: str = RULESET, namespace: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) against the artifacts made by the same rule set."""
    marked = mark_hits(files, artifacts, ruleset, namespace)
    return marked.where("hit").drop("hit"), marked.where("not hit").drop("hit")


def mark_hits(files: DataFrame, artifacts: DataFrame, ruleset: str = RULESET, namespace: str = "") -> DataFrame:
    """`files` with `cache_key` and `hit`, by one join on the key."""
    known = artifacts.where(F.col("ruleset_version") == ruleset).select("cache_key").distinct()
    known = known.withColumn("_known", F.lit(True))
    joined = with_cache_key(files, namespace).join(known, "cache_key", "left")
    return joined.withColumn("hit", F.col("_known").isNotNull()).drop("_known")


def cache_upsert(
    old: DataFrame, new: DataFrame, force: bool = False, keys: Sequence[str] = ("cache_key", "ruleset_version")
) -> DataFrame:
    """The newest artifact per key; at the same instant, and with `force`, the new one.

    A rank limit of one is applied before the shuffle, so a key written over and
    over sends one row per task.
    """
    newest = Window.partitionBy(*keys).orderBy(
        *([F.col("_fresh").desc()] if force else []), F.col("cached_at").desc(), F.col("_fresh").desc()
    )
    both = old.withColumn("_fresh", F.lit(0)).unionByName(new.withColumn("_fresh", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_fresh")


@dataclass
class ReadRun:
    """What one run over a set of files gives."""

    results: DataFrame
    artifacts: DataFrame
    audit: DataFrame


def _judge_and_clean(
    texts: DataFrame, common: Sequence[str], judge: Callable[[DataFrame], DataFrame] | None, rules: Sequence[Rule]
) -> DataFrame:
    """Verdict and sanitized text of files that are not known, from one scan of each."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    scanned = texts.withColumn("_spans", find_spans("text", rules)).withColumn(
        "_categories", F.coalesce(F.sort_array(F.array_distinct(F.transform("_spans", lambda s: s.category))), empty))
    if judge is None:
        evidence = F.concat(F.lit("evidence: "), F.array_join("_categories", ","))
        judged = (
            scanned.withColumn("verdict", evidence_verdict(F.col("_categories"), F.col("text")))
            .withColumn("reason", F.when(F.col("verdict") != "safe", evidence))
            .withColumn("confidence", F.lit(1.0))
        )
    else:
        judged = judge(scanned)
    clean = F.col("verdict") == "flag_pii"
    marked = judged.withColumn("_marks", F.when(clean, number_spans(merge_spans(F.col("_spans")), F.col("text"))))
    return marked.select(
        *common, none.alias("path_reason"), "verdict", F.col("reason").alias("_why"), "confidence",
        F.when(clean, F.size("_marks")).otherwise(0).alias("redaction_count"), F.lit(METHOD_REGEX).alias("_method"),
        F.when(clean, replace_spans(F.col("text"), F.col("_marks"))).alias("sanitized_text"),
        F.when(F.col("verdict") == "safe", F.col("text")).alias("_plain"),
    )


#: What an artifact says besides its text; older stores may lack it, they hold sanitized files only.
ARTIFACT_DEFAULTS = {"verdict": "flag_pii", "reason": None, "confidence": None}


def run_incremental(
    files: DataFrame,
    artifacts: DataFrame,
    roots: Sequence[str],
    now: Column | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None,
    max_bytes: int | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    ruleset: str = RULESET,
) -> ReadRun:
    """Path policy, gate, cache, verdict, redaction, routing and audit, with work for misses only.

    `files` has (doc_id, path, mtime, size_bytes, text).  What can be decided without the text is
    decided from the other columns: policy, images, and the join of cache keys with the
    artifacts, which hold verdict and reason of every file that was read.  Those rows are
    stored.  Texts are then read for misses, to be scanned once for both evidence and redaction, and
    for known safe files, to be passed on; no pattern runs on a known file.  Sanitized texts of
    known files come from the artifacts.  The stored rows pick the texts; they are broadcast if
    they were counted and are few, and else joined by a shuffle on the key.

    `judge` adds `verdict`, `reason` and `confidence` to the texts that were not known, as a model does
    (see `classify`); evidence in the text decides by default, with confidence 1.  Files above `max_bytes`, if the caller sets
    it, say so in their reason and are worked on like all others.

    Results, artifacts and audit read the stored rows of one run.
    """
    now = F.current_timestamp() if now is None else now
    about = with_cache_key(path_policy(files.select("doc_id", "path", "mtime", "size_bytes"), roots))
    known = artifacts.where(F.col("ruleset_version") == ruleset)
    for name, default in ARTIFACT_DEFAULTS.items():
        if name not in known.columns:
            known = known.withColumn(name, F.lit(default).cast("double" if name == "confidence" else "string"))
    old = known.select(
        "cache_key", F.col("verdict").alias("_old_verdict"), F.col("reason").alias("_old_reason"),
        F.col("confidence").alias("_old_confidence"), F.col("redaction_count").alias("_old_count"), F.col("method").alias("_old_method"),
    )
    gate = image_reason(F.col("path"))
    state = (
        F.when(F.col("path_verdict") == "deny", "deny").when(gate.isNotNull(), "gate")
        .when(F.col("_old_verdict").isNotNull(), "hit").otherwise("miss")
    )
    decided = write_through(
        files.sparkSession,
        about.join(old, "cache_key", "left").withColumn("_state", state).withColumn("_gate", gate)
        .withColumn("_note", oversize_reason(F.col("size_bytes"), max_bytes)).withColumn("_now", now),
        "decided",
    )
    needs = (F.col("_state") == "miss") | ((F.col("_state") == "hit") & (F.col("_old_verdict") == "safe"))
    wanted = decided.where(needs).drop("doc_id", "path", "mtime", "size_bytes", "path_verdict", "path_reason").dropDuplicates(["cache_key"])
    wanted = write_through(files.sparkSession, wanted, "wanted")
    all_known = wanted.where("_state = 'miss'").isEmpty()
    texts = with_cache_key(files).join(broadcast_if_small(wanted), "cache_key")

    common = ["doc_id", "path", "mtime", "size_bytes", "cache_key", "_state", "_gate", "_note", "_now"]
    none = F.lit(None).cast("string")
    if all_known:
        misses = decided.limit(0).select(
            *common, none.alias("path_reason"), none.alias("verdict"), none.alias("_why"), F.lit(None).cast("double").alias("confidence"),
            F.lit(0).alias("redaction_count"), none.alias("_method"), none.alias("sanitized_text"), none.alias("_plain"))
    else:
        misses = write_through(files.sparkSession, _judge_and_clean(texts.where("_state = 'miss'"), common, judge, rules), "misses")

    def from_artifact(rows: DataFrame, sanitized: Column, plain: Column) -> DataFrame:
        return rows.select(
            *common, none.alias("path_reason"), F.col("_old_verdict").alias("verdict"), F.col("_old_reason").alias("_why"),
            F.col("_old_confidence").alias("confidence"), F.col("_old_count").alias("redaction_count"), F.col("_old_method").alias("_method"),
            sanitized.alias("sanitized_text"), plain.alias("_plain"),
        )

    hits = decided.where("_state = 'hit'")
    stored = known.where("verdict = 'flag_pii'").select("cache_key", F.col("sanitized_text").alias("_old_text"))
    cleaned = from_artifact(hits.where("_old_verdict = 'flag_pii'").join(stored, "cache_key"), F.col("_old_text"), none)
    passed = from_artifact(texts.where("_state = 'hit'"), none, F.col("text"))
    withheld = from_artifact(hits.where("_old_verdict not in ('flag_pii', 'safe')"), none, none)
    closed = decided.where("_state in ('deny', 'gate')").select(
        *common, "path_reason", F.when(F.col("_state") == "deny", "deny").otherwise("escalate").alias("verdict"), none.alias("_why"),
        F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("redaction_count"), none.alias("_method"), none.alias("sanitized_text"), none.alias("_plain"),
    )
    done = misses
    for part in (cleaned, passed, withheld, closed):
        done = done.unionByName(part)
    cached = F.col("_state") == "hit"
    why = (
        F.when(F.col("_state") == "deny", F.col("path_reason")).when(F.col("_state") == "gate", F.col("_gate"))
        .otherwise(F.nullif(F.concat_ws("; ", "_why", "_note"), F.lit("")))
    )
    results = done.select(
        "doc_id", "path", "cache_key", "verdict",
        F.when(cached, "cached").otherwise(file_format(F.col("path"))).alias("format"),
        why.alias("reason"),
        "confidence",
        F.when(F.col("verdict") == "deny", "deny_path").when(cached, "cache_hit").otherwise(audit_action(F.col("verdict"))).alias("action"),
        F.when(F.col("verdict") == "deny", "denied")
        .when(F.col("_state") == "gate", "request_permission")
        .when(F.col("verdict") == "safe", "classified-safe")
        .when(F.col("verdict") == "escalate", "classified-escalate")
        .when(F.col("verdict") == "block", "classified-block")
        .otherwise(F.col("_method")).alias("method"),
        cached.alias("cached"),
        F.when(F.col("verdict") == "flag_pii", F.col("redaction_count")).otherwise(0).alias("redaction_count"),
        F.coalesce("_plain", "sanitized_text").alias("content"),
        F.when(F.col("verdict") == "escalate", review_message(F.coalesce(why, F.lit("")))).alias("message"),
        F.col("_now").alias("decided_at"),
    )
    made = misses.select(
        "cache_key", "path", "mtime", "size_bytes", F.lit(ruleset).alias("ruleset_version"), "verdict", F.col("_why").alias("reason"),
        "confidence", "sanitized_text", "redaction_count", F.col("_method").alias("method"), F.col("_now").alias("cached_at"),
    )
    audit = results.select(
        F.col("decided_at").alias("timestamp"), F.lit("read").alias("event"), "path", "action", "reason", "redaction_count", "method")
    return ReadRun(results.drop("decided_at"), made, audit)
