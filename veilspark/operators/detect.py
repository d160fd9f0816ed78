"""Detection jobs: one row per finding."""
from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.spans import find_spans, merge_spans


def detect(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[P.Rule] = P.DEFAULT_RULES,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(keys, category, value, start, end), one row per span, one pass over the text."""
    return docs.select(*keys, F.inline(find_spans(text, rules))).select(
        *keys, "category", "priority", "value", "start", "end"
    )


def detect_category(docs: DataFrame, category: str, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """The spans of one category alone."""
    rules = [rule for rule in P.DEFAULT_RULES if rule.category == category]
    if not rules:
        raise ValueError(f"unknown category: {category}")
    return detect(docs, text, rules, keys).drop("priority")


def merge_rows(docs: DataFrame, text: str = "text", keys=("doc_id",), rules=P.DEFAULT_RULES) -> DataFrame:
    """Disjoint spans of each document, found and merged inside the row."""
    return docs.select(*keys, F.inline(merge_spans(find_spans(text, rules)))).select(
        *keys, "category", "start", "end"
    )


def resolve_overlaps(detections: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Disjoint spans from a table of detections, by gaps and islands per document."""
    by_place = Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), "priority")
    reach = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    best = F.struct(F.col("start"), -F.col("end"), F.col("priority"))
    return (
        detections.withColumn("_new", new)
        .withColumn("_island", F.sum("_new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(
            F.min_by("category", best).alias("category"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
        .drop("_island")
    )


def detection_profile(
    docs: DataFrame, dims: Sequence[str] = ("lang", "source"), text: str = "text"
) -> DataFrame:
    """Hits and documents with hits, by category and every combination of `dims`.

    A document enters each (category, cell) once, already counted inside its row,
    so no distinct count is needed and a cell of any size is summed map-side.
    The category `ALL` counts every document, with or without hits.
    """

    def per_category(spans: Column) -> Column:
        names = F.array_distinct(F.transform(spans, lambda s: s.category))
        one = F.transform(
            names,
            lambda c: F.struct(
                c.alias("category"),
                F.size(F.filter(spans, lambda s: s.category == c)).alias("hits"),
            ),
        )
        every = F.struct(F.lit("ALL").alias("category"), F.size(spans).alias("hits"))
        return F.concat(one, F.array(every))

    found = docs.select(*dims, find_spans(text).alias("_spans"))
    exploded = found.select(*dims, F.inline(F.get(F.transform(F.array("_spans"), per_category), F.lit(0))))
    cells = [[*cell, "category"] for k in range(len(dims) + 1) for cell in combinations(dims, k)]
    return (
        exploded.groupingSets(cells, *dims, "category")
        .agg(
            *[F.grouping(d).alias(f"_all_{d}") for d in dims],
            F.sum("hits").cast("long").alias("hits"),
            F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).cast("long").alias("docs_hit"),
            F.count(F.lit(1)).alias("docs_counted"),
        )
        .select(
            *[F.when(F.col(f"_all_{d}") == 1, "*").otherwise(F.col(d)).alias(d) for d in dims],
            "category",
            "hits",
            "docs_hit",
            F.when(
                F.col("category") == "ALL",
                F.round(F.col("docs_hit") / F.col("docs_counted"), 6),
            ).alias("hit_rate"),
        )
    )


def _rule_test(text: Column, lowered: Column, pattern: str, needle: str) -> Column:
    first = re.match(r"\\b([A-Za-z0-9])(?![?*{])", pattern)
    if first:
        # one character fails faster than a boundary
        pattern = f"(?={first[1]}){pattern}"
    test = F.rlike(text, F.lit(P.spark_pattern(pattern, unicode_words=True)))
    return (F.contains(lowered, F.lit(needle)) & test) if needle else test


def matched_rules(text: Column, rules: Sequence[tuple[str, str, str]], lowered: Column | None = None) -> Column:
    """Names of the rules that match, as an array in table order.

    The nulls are taken out with a set function, not a lambda, to stay in
    generated code.  Give `lowered` as a column of its own where the array is exploded at once: a
    generator would lower-case the text once for every rule.
    """
    lowered = F.lower(text) if lowered is None else lowered
    names = F.array(
        *[F.when(_rule_test(text, lowered, pattern, needle), F.lit(name)) for name, pattern, needle in rules]
    )
    return F.array_except(names, F.array(F.lit(None).cast("string")))


def any_rule(text: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Whether any rule matches; stops at the first one."""
    lowered = F.lower(text)
    test = F.lit(False)
    for _, pattern, needle in reversed(rules):
        test = F.when(_rule_test(text, lowered, pattern, needle), F.lit(True)).otherwise(test)
    return test


def scan_rules(docs: DataFrame, rules: Sequence[tuple[str, str, str]], text: str = "text", keys=("doc_id",)) -> DataFrame:
    """(keys, rule): every rule of the table that matches a document."""
    lowered = docs.select(*keys, F.col(text).alias("_text"), F.lower(text).alias("_lowered"))
    return lowered.select(*keys, F.explode(matched_rules(F.col("_text"), rules, F.col("_lowered"))).alias("rule"))


def live_secret_rules(text: Column) -> Column:
    """Names of the live-secret rules with a match that is neither a known example nor a dummy."""
    empty = F.lit(None).cast("string")

    def named(name: str, pattern: str, known: Sequence[str]) -> Column:
        def real(match: Column) -> Column:
            fake = F.lit(False)
            for word in P.LIVE_SECRET_FAKE_WORDS:
                fake = fake | F.contains(match, F.lit(word))
            if known:
                fake = fake | match.isin(*known)
            variety = F.size(F.array_distinct(F.filter(F.split(match, "", -1), lambda c: c != F.lit(""))))
            return ~fake & (variety > P.LIVE_SECRET_MAX_FAKE_CHARS)

        prefix = pattern.replace(r"\b", "").split("[")[0]
        # one character fails faster than a boundary
        ahead = f"(?={prefix[0]}){pattern}"
        found = F.regexp_extract_all(text, F.lit(P.spark_pattern(ahead, unicode_words=True)), F.lit(0))
        return F.when(F.contains(text, F.lit(prefix)) & F.exists(found, real), F.lit(name)).otherwise(empty)

    names = F.array(*[named(*rule) for rule in P.LIVE_SECRET_RULES])
    return F.filter(names, lambda n: n.isNotNull())


def scan_real_secret(docs: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """(keys, has_real_secret, rule): the first live-secret rule that holds, if any.

    All matches of a rule are looked at, so an example key does not hide a real one.
    """
    return docs.select(*keys, live_secret_rules(F.col(text)).alias("_rules")).select(
        *keys, (F.size("_rules") > 0).alias("has_real_secret"), F.get("_rules", F.lit(0)).alias("rule")
    )
