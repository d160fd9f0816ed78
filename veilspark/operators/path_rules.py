"""Path policy from a rule table: globs indexed by what they hold literally, joined to paths by equal keys.

A chain of literal patterns (see `policy`) holds a few rules; this holds as many as a table does.  Every rule
gets one key that any path it matches must show, the first of these that it has:

    p:/a/b     the folders in front of its first wildcard, if it is anchored at the root
    s:name     its longest segment without a wildcard
    e:.ext     the literal end of its last segment, from its first dot on
    n:pref     the literal start of its last segment, up to `PREFIX` characters
    any        none of them

A path shows the keys of its folders, segments, endings and name starts, some tens of them.  Joined rules are
verified by their pattern, and the least rank of each kind decides.  So a path is tested against the few
rules that share a key with it, however many there are.

Defined results: a null path is not under a root; ranks may repeat, of equal ones the glob first in order is
named; rules with a null glob or kind match nothing; repeated paths get equal answers; columns of `files` pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.globs import normal_path
from veilspark.functions.spans import let
from veilspark.operators.policy import REASON_ALWAYS, REASON_DEFAULT, REASON_DENY, REASON_ROOT
from veilspark.session import broadcast_if_small, write_through

DENY, ROOT, SANITIZE = "deny", "root", "sanitize"
PREFIX = 8
_WILD = r"[*?]"


def glob_pattern(glob: Column) -> Column:
    """The anchored regex of a glob column, as `functions.globs.glob_regex` makes it from a literal."""
    out = F.regexp_replace(glob, r"([\\.^$+(){}\[\]|])", r"\\$1")
    for mark, text in enumerate(("**/", "**", "*", "?"), 1):
        out = F.replace(out, F.lit(text), F.lit(chr(mark)))
    for mark, text in enumerate(("(?:.*/)?", ".+", "[^/]*", "[^/]"), 1):
        out = F.replace(out, F.lit(chr(mark)), F.lit(text))
    return F.concat(F.when(F.contains(glob, F.lit("/")), "^").otherwise("^(?:.*/)?"), out, F.lit("$"))


def rule_key(glob: Column) -> Column:
    """The key that every path which the glob matches shows."""

    def of(parts: Column) -> Column:
        literal = F.filter(parts, lambda p: (p != "") & ~F.rlike(p, F.lit(_WILD)))
        first_wild = F.array_position(F.transform(parts, lambda p: F.rlike(p, F.lit(_WILD))), True)
        folders = F.slice(parts, F.lit(1), F.when(first_wild == 0, F.size(parts)).otherwise(first_wild - 1).cast("int"))
        longest = F.get(F.array_sort(F.transform(literal, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), F.lit(0))["p"]
        last = F.get(parts, F.size(parts) - 1)
        end, start = F.regexp_extract(last, r"^[^.]*[*?][^.]*(\.[^*?]+)$", 1), F.regexp_extract(last, r"^([^*?]+)[*?]", 1)
        # `x**/y` may match `xy`: what follows is no segment of its own
        loose = F.exists(parts, lambda p: F.rlike(p, F.lit(r"[^*]\*\*+$|^\*\*\*+$")))
        return (
            F.when(F.startswith(glob, F.lit("/")) & (F.size(folders) > 1), F.concat(F.lit("p:"), F.array_join(folders, "/")))
            .when(loose, "any")
            .when(F.size(literal) > 0, F.concat(F.lit("s:"), longest))
            .when(end != "", F.concat(F.lit("e:"), end))
            .when(start != "", F.concat(F.lit("n:"), F.left(start, F.lit(PREFIX))))
            .otherwise("any")
        )

    return let(F.split(glob, "/", -1), of)


def path_keys(path: Column) -> Column:
    """All keys that a normalised path shows."""

    def of(parts: Column) -> Column:
        numbers = lambda n: F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        folders = F.transform(numbers(F.size(parts)), lambda n: F.concat(F.lit("p:"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
        segments = F.transform(parts, lambda p: F.concat(F.lit("s:"), p))
        last = F.get(parts, F.size(parts) - 1)
        dots = F.split(last, r"\.", -1)
        endings = F.transform(F.slice(dots, F.lit(2), F.size(dots)), lambda _, i: F.concat(F.lit("e:."), F.array_join(F.slice(dots, i + 2, F.size(dots)), ".")))
        starts = F.transform(numbers(F.least(F.length(last), F.lit(PREFIX))), lambda n: F.concat(F.lit("n:"), F.left(last, n)))
        return F.array_distinct(F.concat(folders, segments, endings, starts, F.array(F.lit("any"))))

    return let(F.split(path, "/", -1), of)


def rule_table(spark, roots, deny, always) -> DataFrame:
    """(rank, kind, glob) of the literal lists that `policy.path_policy` takes."""
    rows = [(i, DENY, g) for i, g in enumerate(deny)] + [(i, SANITIZE, g) for i, g in enumerate(always)]
    for root in roots:
        clean = "/" + root.strip("/")
        rows += [(0, ROOT, clean), (0, ROOT, clean.rstrip("/") + "/**")]
    return spark.createDataFrame(rows, "rank long, kind string, glob string")


def path_policy_by_rules(files: DataFrame, rules: DataFrame, *, path_col: str = "path") -> DataFrame:
    """Adds `path_verdict` (deny or sanitize) and `path_reason` from rules (rank, kind, glob).

    The least rank of a deny rule decides, then whether any root rule matches, then the least rank of
    a sanitize rule.  The rules are broadcast if they were counted and are few, and joined by a shuffle on
    the key beyond that; only paths that some rule matches are grouped.
    """
    spark = files.sparkSession
    indexed = rules.where("glob IS NOT NULL AND kind IS NOT NULL").select(
        "rank", "kind", "glob", glob_pattern(F.col("glob")).alias("pattern"), rule_key(F.col("glob")).alias("key"))
    indexed = broadcast_if_small(write_through(spark, indexed, "path_rules"))
    path = F.col(f"`{path_col}`")
    asked = files.select(path.alias("asked")).where("asked IS NOT NULL").distinct().withColumn("clean", normal_path(F.col("asked")))
    shown = asked.select("asked", "clean", F.explode(path_keys(F.col("clean"))).alias("key"))
    hits = shown.join(indexed, "key").where(F.expr("clean RLIKE pattern"))
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("rank", "glob")))
    found = hits.groupBy("asked").agg(least(DENY).alias("deny"), F.bool_or(F.col("kind") == ROOT).alias("rooted"), least(SANITIZE).alias("always"))
    said = lambda text, glob: F.concat(F.lit(text.format("")), F.col(glob))
    reason = (
        F.when(F.col("deny").isNotNull(), said(REASON_DENY, "deny.glob"))
        .when(F.col("rooted"), F.when(F.col("always").isNotNull(), said(REASON_ALWAYS, "always.glob")).otherwise(REASON_DEFAULT))
        .otherwise(REASON_ROOT)
    )
    allowed = F.coalesce(F.col("deny").isNull() & F.col("rooted"), F.lit(False))
    found = found.select("asked", reason.alias("why"), F.when(allowed, "sanitize").otherwise("deny").alias("verdict"))
    kept = [F.col(f"f.`{c}`") for c in files.columns if c not in ("path_reason", "path_verdict")]
    joined = files.alias("f").join(found.alias("r"), F.col(f"f.`{path_col}`") == F.col("r.asked"), "left")
    return joined.select(*kept, F.coalesce("r.why", F.lit(REASON_ROOT)).alias("path_reason"), F.coalesce("r.verdict", F.lit("deny")).alias("path_verdict"))
