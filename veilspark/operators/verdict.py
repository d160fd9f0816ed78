"""Verdicts, routing and audit actions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.spans import find_spans
from veilspark.operators.redact import METHOD_REGEX

# --- fixed values ---------------------------------------------------------
LABELS = ("classify_safe", "flag_pii", "block_transfer", "request_permission")
VERDICTS = {
    "classify_safe": "safe",
    "flag_pii": "flag_pii",
    "block_transfer": "block",
    "request_permission": "escalate",
}
FALLBACK_LABEL = "request_permission"
FALLBACK_VERDICT = "flag_pii"
DEFAULT_PII_TYPES = "email,phone,ssn"
ACTIONS = {
    "safe": "classify_safe",
    "block": "block_transfer",
    "escalate": "escalate",
    "flag_pii": "sanitize",
}
REVIEW_MESSAGE = (
    "This file requires human review before it can be shared. Reason: {reason}. "
    "Please ask the user for explicit permission before proceeding."
)
# ----------------------------------------------------------------------------
SECRET_CATEGORIES = ("SECRET", "HIGH_ENTROPY")
INTERNAL_WORDS = r"(?i)\b(?:confidential|non-disclosure|internal use only|do not distribute)\b"

CLASSIFY_SCHEMA = (
    "struct<tool:string,arguments:struct<reason:string,types:string>,confidence:double,"
    "_corrupt_record:string>"
)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def verdict_of_label(label: Column) -> Column:
    """The verdict that a label stands for; null for an unknown label."""
    return _lookup(label, VERDICTS)


def backend_answer(raw: Column) -> Column:
    """Classifier output as a struct; malformed or off-list answers ask a person, at confidence 0."""
    parsed = F.from_json(raw, CLASSIFY_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    good = parsed["_corrupt_record"].isNull() & parsed["tool"].isin(*LABELS)
    return F.when(
        F.coalesce(good, F.lit(False)),
        F.struct(
            parsed["tool"].alias("tool"),
            parsed["arguments"]["reason"].alias("reason"),
            parsed["arguments"]["types"].alias("types"),
            F.coalesce(parsed["confidence"], F.lit(0.5)).alias("confidence"),
        ),
    ).otherwise(
        F.struct(
            F.lit(FALLBACK_LABEL).alias("tool"),
            F.lit("Could not parse model response").alias("reason"),
            F.lit(None).cast("string").alias("types"),
            F.lit(0.0).alias("confidence"),
        )
    )


def map_verdict(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds verdict, reason, confidence and pii_types to classifier outputs.

    A missing answer (the classifier was not reached) is treated as personal
    data, so that it is sanitized; a malformed one asks a person.
    """
    reached = F.col(raw).isNotNull()
    a = F.col("_answer")
    return (
        answers.withColumn("_answer", F.when(reached, backend_answer(F.col(raw))))
        .withColumn("verdict", F.coalesce(_lookup(a.tool, VERDICTS), F.lit(FALLBACK_VERDICT)))
        .withColumn(
            "reason",
            F.when(~reached, F.lit("Classifier unavailable")).otherwise(
                F.coalesce(a.reason, a.types, F.concat(F.lit("classified as "), a.tool))
            ),
        )
        .withColumn("confidence", F.coalesce(a.confidence, F.lit(0.0)))
        .withColumn(
            "pii_types",
            F.when(
                F.col("verdict") == FALLBACK_VERDICT,
                F.split(F.coalesce(a.types, F.lit(DEFAULT_PII_TYPES)), r"\s*,\s*", -1),
            ),
        )
        .drop("_answer")
    )


def evidence_verdict(categories: Column, text: Column) -> Column:
    """Verdict from the categories found: secrets, then personal data, then internal papers, else safe."""
    secret = F.arrays_overlap(categories, F.array(*[F.lit(c) for c in SECRET_CATEGORIES]))
    return (
        F.when(secret, "block")
        .when(F.size(categories) > 0, "flag_pii")
        .when(F.rlike(text, F.lit(P.spark_pattern(INTERNAL_WORDS, unicode_words=True))), "escalate")
        .otherwise("safe")
    )


def with_rule_verdict(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[P.Rule] = P.DEFAULT_RULES,
    spans: str | None = None,
) -> DataFrame:
    """Adds `verdict` and `categories`; `spans` names a column with the text's spans."""
    found = find_spans(text, rules) if spans is None else F.col(spans)
    categories = F.sort_array(F.array_distinct(F.transform(found, lambda s: s.category)))
    return (
        docs.withColumn("_categories", categories)
        .withColumn("verdict", evidence_verdict(F.col("_categories"), F.col(text)))
        .withColumn("categories", F.array_join("_categories", ","))
        .drop("_categories")
    )


def rule_verdict(
    docs: DataFrame, text: str = "text", rules: Sequence[P.Rule] = P.DEFAULT_RULES, keys=("doc_id",)
) -> DataFrame:
    """(keys, verdict, categories) from evidence in the text, where no model is at hand."""
    return with_rule_verdict(docs, text, rules).select(*keys, "verdict", "categories")


def review_message(reason: Column) -> Column:
    """What a person is told who must decide about a file."""
    return F.replace(F.lit(REVIEW_MESSAGE), F.lit("{reason}"), reason)


def route_documents(docs: DataFrame, classify: bool = True) -> DataFrame:
    """What leaves for each document, by verdict.

    `docs` has text, verdict, reason, sanitized_text and redaction_count.  Adds
    content, method, `count` (0 where nothing was replaced), `escalation` and
    `block_reason`.  Without `classify` everything is sanitized.
    """
    verdict = F.col("verdict") if classify else F.lit("flag_pii")
    return (
        docs.withColumn("_v", verdict)
        .withColumn(
            "content",
            F.when(F.col("_v") == "safe", F.col("text")).when(F.col("_v") == "flag_pii", F.col("sanitized_text")),
        )
        .withColumn(
            "method",
            F.when(F.col("_v") == "safe", "classified-safe")
            .when(F.col("_v") == "flag_pii", METHOD_REGEX)
            .when(F.col("_v") == "escalate", "classified-escalate")
            .otherwise("classified-block"),
        )
        .withColumn("count", F.when(F.col("_v") == "flag_pii", F.col("redaction_count")).otherwise(0))
        .withColumn(
            "escalation",
            F.when(F.col("_v") == "escalate", review_message(F.col("reason"))),
        )
        .withColumn("block_reason", F.when(F.col("_v") == "block", F.col("reason")))
        .drop("_v")
    )


def audit_action(verdict: Column) -> Column:
    return F.coalesce(_lookup(verdict, ACTIONS), F.lit("sanitize"))


def audit_actions(decisions: DataFrame, verdict: str = "verdict") -> DataFrame:
    """(action, n): decisions counted by the action that is logged for them."""
    return decisions.groupBy(audit_action(F.col(verdict)).alias("action")).agg(
        F.count(F.lit(1)).alias("n")
    )
