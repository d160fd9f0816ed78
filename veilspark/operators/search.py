"""Search that only ever returns cleaned lines."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.patterns import DEFAULT_RULES, Rule, spark_pattern
from veilspark.functions.spans import let, replace_spans
from veilspark.operators.policy import path_policy
from veilspark.operators.redact import marks_of


def search_sanitized(
    files: DataFrame,
    query: str,
    roots: Sequence[str],
    max_results: int | None = None,
    limit: int | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
) -> DataFrame:
    """(path, line, snippet, file_matches) for lines that match a regex.

    All matching lines are returned, unless the caller sets a limit: the first
    `max_results` of each file, or the first `limit` over all files in (path, line)
    order.  `file_matches` is a file's true number of matches.  Files that policy denies are not searched.  The lines
    are picked inside the row, before anything is exploded.
    """
    regex = spark_pattern(query)

    def matching(lines: Column) -> Column:
        """The piece after a final line break is not a line."""
        return F.filter(
            F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("raw"))),
            lambda x: F.rlike(x.raw, F.lit(regex)) & ((x.raw != "") | (x.line < F.size(lines))),
        )

    hits = let(F.split(F.col("text"), "\n", -1), matching)
    # Unless the query looks at the ends of its input, the whole text can be
    # tested before it is cut into lines.
    plain = not any(sign in query for sign in ("(?", r"\A", r"\z", r"\Z"))
    maybe = F.rlike("text", F.lit("(?m)" + regex)) if plain else F.lit(True)
    picked = (
        path_policy(files, roots)
        .where(F.col("path_verdict") != "deny")
        .where(maybe)
        .select(
            "path",
            F.inline(
                let(
                    hits,
                    lambda h: F.transform(
                        h if max_results is None else F.slice(h, 1, max_results),
                        lambda x: F.struct(x.line.alias("line"), x.raw.alias("raw"), F.size(h).alias("n")),
                    ),
                )
            ),
        )
    )
    cleaned = picked.withColumn("marks", marks_of("raw", rules)).select(
        "path",
        "line",
        F.trim(replace_spans(F.col("raw"), F.col("marks"))).alias("snippet"),
        F.col("n").alias("file_matches"),
    )
    return cleaned if limit is None else cleaned.orderBy("path", "line").limit(limit)
