"""The vault: which original text stands behind which placeholder."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.patterns import OWN_PLACEHOLDER, spark_pattern
from veilspark.functions.spans import let


def build_vault(placeholders: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope_id, placeholder, original, category, added_at); the last entry per key wins.

    `placeholders` has the scope column, placeholder, original, category and
    added_at.  Entries at the same instant are settled by their original text.
    """
    newest = F.struct("added_at", "original", "category")
    return (
        placeholders.groupBy(F.col(scope).alias("scope_id"), "placeholder")
        .agg(F.max(newest).alias("_e"))
        .select("scope_id", "placeholder", "_e.original", "_e.category", "_e.added_at")
    )


def lookup(used: DataFrame, vault: DataFrame) -> DataFrame:
    """What is known about placeholders, without their originals."""
    return used.join(vault.drop("original"), ["scope_id", "placeholder"])


def rehydrate(docs: DataFrame, vault: DataFrame, text: str = "sanitized_text") -> DataFrame:
    """Put the originals back, for callers who may see them.

    Placeholders are found in the text by pattern, so `__EMAIL_1__` never hits
    inside `__EMAIL_10__`; unknown ones stay.  A source text that spells out one of its
    own placeholders cannot be told from it.  Only placeholders travel to the
    vault join, not the texts.
    """
    pattern = F.lit(spark_pattern(OWN_PLACEHOLDER))
    used = docs.select(
        "doc_id",
        F.posexplode(F.regexp_extract_all(F.col(text), pattern, F.lit(0))).alias("pos", "placeholder"),
    )
    entries = vault.select(F.col("scope_id").alias("doc_id"), "placeholder", "original")
    values = (
        used.join(entries, ["doc_id", "placeholder"], "left")
        .groupBy("doc_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("pos", F.coalesce("original", "placeholder").alias("value")))
            ).alias("_values")
        )
    )

    def restore(gaps: Column) -> Column:
        pieces = F.transform(F.col("_values"), lambda v, i: F.concat(F.get(gaps, i), v.value))
        return F.concat(F.array_join(pieces, ""), F.get(gaps, F.size("_values")))

    restored = let(F.split(F.col(text), pattern, -1), restore)
    return (
        docs.join(values, "doc_id", "left")
        .withColumn(
            "restored_text", F.when(F.col("_values").isNotNull(), restored).otherwise(F.col(text))
        )
        .drop("_values")
    )


def policy_report(vault: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Vault size and placeholders per category, never the originals, plus the settings given.

    The placeholder names are one row each only in the per-category counts; names
    such as `__EMAIL_1__` recur in many documents, so their distinct list is short
    next to the vault.
    """
    names = vault.groupBy("category", "placeholder").agg(F.count(F.lit(1)).alias("entries"))
    report = names.select(
        F.lit("vault").alias("section"), F.col("category").alias("name"), "placeholder", "entries"
    )
    for key, value in (settings or {}).items():
        report = report.unionByName(
            vault.sparkSession.range(1).select(
                F.lit("policy").alias("section"),
                F.lit(key).alias("name"),
                F.lit(value).alias("placeholder"),
                F.lit(0).cast("long").alias("entries"),
            )
        )
    return report
