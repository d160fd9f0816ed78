"""One query per operator, over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import (
    alignment, chunks, decontaminate, jaccard, lines, pieces, pii, quality, rules, secrets, sql, templates, tokens, whitening,
)
from veilspark.llm.common import table
from veilspark.llm.registry import query


@query("op8_quality_rules", sql.QUALITY_RULES)
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every document."""
    return rules.quality_report(table(spark, sf, "documents"))


@query("op10_decontamination", sql.DECONTAMINATION)
def decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("hit_runs")


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every line of every field."""
    return tokens.attribute(table(spark, sf, "documents"))


@query("op6_sentencepiece")
def sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded segmentation of every document, decoded again."""
    return pieces.round_trip(table(spark, sf, "documents"))


@query("op7_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Class, links and group of every document."""
    return jaccard.near_copies(table(spark, sf, "documents")).drop("row")


@query("op9_line_dedup")
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that every document keeps and loses."""
    return lines.dedup_report(table(spark, sf, "documents"))


@query("op5_substring_dedup")
def substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated passages of every document."""
    return chunks.repeat_report(table(spark, sf, "documents"))


@query("op1_secret_scan")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.secret_report(table(spark, sf, "documents"))


@query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every document, by a model of the labelled ones that are not held out."""
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf, "labels")))


@query("op4_html_extraction")
def html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return templates.main_text(table(spark, sf, "pages"))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.components_table(table(spark, sf, "embeddings"))


@query("op13_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment of two tokenizers over every document."""
    return alignment.alignment_report(table(spark, sf, "documents"))


@query("op12_pii")
def personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document."""
    return pii.pii_report(table(spark, sf, "documents"))
