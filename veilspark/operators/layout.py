"""From positioned text runs to redaction rectangles."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.patterns import BEYOND_LATIN, DEFAULT_RULES, NARROW_SPACE, SPACE, WIDE_SPACE, Rule
from veilspark.functions.spans import find_spans, let, running_total

# --- fixed values ---------------------------------------------------------
DEFAULT_HEIGHT = 12.0
LINE_GRID = 2
GAP = 10.0
PADDING = 1.0
RECT_REASON = "PII redacted"
# ----------------------------------------------------------------------------


def _by_space(text: Column, use: Callable[[str], Column]) -> Column:
    """`use` with the class of white space, without its wide characters where the text has none of them.

    A class of narrow characters is a bit set; one with wide ranges is tested range by range.
    """
    wide = F.rlike(text, F.lit(BEYOND_LATIN)) & F.rlike(text, F.lit(WIDE_SPACE))
    return F.when(wide, use(SPACE)).otherwise(use(NARROW_SPACE))


def _word_list(text: Column) -> Column:
    """The pieces of a text between white space."""
    return _by_space(text, lambda space: F.filter(F.split(text, f"[{space}]+", -1), lambda w: w != F.lit("")))


def _gap_list(text: Column) -> Column:
    """The white space before each word, and maybe after the last."""
    def gaps(space: str) -> Column:
        seps = F.regexp_extract_all(text, F.lit(f"[{space}]+"), F.lit(0))
        return F.when(F.rlike(text, F.lit(f"^[{space}]")), seps).otherwise(F.concat(F.array(F.lit("")), seps))

    return _by_space(text, gaps)


def _words(text: Column, spans: Column | None) -> Column:
    """The words of a run: struct(pos, word, chars, category, value).

    `chars` counts the characters before a word if words were one space apart, which is how x
    moves; category and value are those of the first span that the word overlaps in the text
    itself, so that a value written over several words flags them all.  Where a word stands in the
    text is worked out only for runs with a span.
    """
    none = F.lit(None).cast("struct<category:string,value:string>")

    def listed(words: Column, hit: Callable[[Column, Column], Column]) -> Column:
        return let(
            running_total(F.transform(words, lambda w: F.length(w) + 1)),
            lambda ends: F.transform(words, lambda w, i: let(hit(w, i), lambda h: F.struct(
                i.alias("pos"), w.alias("word"), (F.get(ends, i) - F.length(w) - 1).alias("chars"),
                h.category.alias("category"), h["value"].alias("value")))),
        )

    def over(spans: Column, start: Column, end: Column) -> Column:
        first = F.get(F.filter(spans, lambda s: (s.start < end) & (s.end > start)), F.lit(0))
        return let(first, lambda s: F.when(s.isNotNull(), F.struct(s.category.alias("category"), s["value"].alias("value"))))

    def among(words: Column, spans: Column) -> Column:
        """The words of a run with spans, each with the first one over it."""
        widths = let(_gap_list(text), lambda g: F.transform(words, lambda w, i: F.length(F.get(g, i)) + F.length(w)))
        return let(running_total(widths), lambda ends: listed(
            words, lambda w, i: over(spans, F.get(ends, i) - F.length(w), F.get(ends, i))))

    def found(words: Column) -> Column:
        plain = listed(words, lambda w, i: none)
        return plain if spans is None else F.when(F.size(spans) > 0, among(words, spans)).otherwise(plain)

    return let(_word_list(text), found)


def runs_to_tokens(runs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(doc_id, token_id, page, text, x, y, w, h) from text runs; with `rules` also category and value.

    `runs` has (doc_id, page, run, text, x, y, width, height).  A run's words
    share its y and height; x moves by character share of the run's width.
    Patterns run once per run of text, and a word that overlaps a hit carries it.
    Ids count from 0 over a document in (page, run, word) order.  Only the runs are shuffled, once
    and by document: a running sum of their numbers of words gives the ids, and words and spans are made
    behind it, so that what follows by document needs no further shuffle.
    """
    before = Window.partitionBy("doc_id").orderBy("page", "run").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        runs.where(F.rlike("text", F.lit(f"[^{SPACE}]")) & F.col("doc_id").isNotNull() & F.col("page").isNotNull())
        .withColumn("_n", F.size(_word_list(F.col("text"))))
        .withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_char", F.col("width") / F.length("text"))
    )
    spans = None
    if rules is not None:
        placed, spans = placed.withColumn("_spans", find_spans("text", rules)), F.col("_spans")
    # the array is no column of its own: a filter on its size would make it a second time
    return (
        placed.select("doc_id", "page", "x", "y", "height", "_at", "_char", F.inline(_words(F.col("text"), spans)))
        .select(
            "doc_id",
            (F.col("_at") + F.col("pos")).cast("long").alias("token_id"),
            "page",
            F.col("word").alias("text"),
            (F.col("x") + F.col("chars") * F.col("_char")).alias("x"),
            "y",
            (F.length("word") * F.col("_char")).alias("w"),
            # a height of 0 counts as missing
            F.coalesce(F.nullif(F.col("height"), F.lit(0.0)), F.lit(DEFAULT_HEIGHT)).alias("h"),
            *([] if rules is None else ["category", "value"]),
        )
    )


def flag_tokens(
    tokens: DataFrame,
    known_values: DataFrame | None = None,
    selected: DataFrame | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
) -> DataFrame:
    """The tokens to cover: with a detection, equal to a value known as
    sensitive in that document, or picked by a model.

    Tokens that carry a category were looked at as part of their run; others are looked at one by
    one.  `known_values` has (doc_id, text), `selected` (doc_id, token_id); either may
    hold duplicates.  Both become one set per document, joined once by hash, so that the tokens are
    not sorted for it.
    """
    hit = F.col("category").isNotNull() if "category" in tokens.columns else F.size(find_spans("text", rules)) > 0
    flagged = tokens.withColumn("_hit", hit)
    text, place = F.lit(None).cast("string"), F.lit(None).cast("long")
    asked = []
    if known_values is not None:
        asked.append(known_values.select("doc_id", F.col("text").alias("_text"), place.alias("_place")))
    if selected is not None:
        asked.append(selected.select("doc_id", text.alias("_text"), F.col("token_id").alias("_place")))
    if asked:
        rows = asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1])
        sets = rows.groupBy("doc_id").agg(F.collect_set("_text").alias("_texts"), F.collect_set("_place").alias("_places"))
        flagged = flagged.join(sets.hint("shuffle_hash"), "doc_id", "left")
        in_sets = F.array_contains("_texts", F.col("text")) | F.array_contains("_places", F.col("token_id"))
        flagged = flagged.withColumn("_hit", F.col("_hit") | F.coalesce(in_sets, F.lit(False)))
    return flagged.where("_hit").select(*tokens.columns)


def layout_vault(flagged: DataFrame) -> DataFrame:
    """(doc_id, category, original, placeholder): each value behind flagged tokens, numbered per document
    and category by its first token."""
    firsts = flagged.where("category is not null").groupBy("doc_id", "category", F.col("value").alias("original")).agg(
        F.min("token_id").alias("_first"))
    order = Window.partitionBy("doc_id", "category").orderBy("_first", "original")
    number = F.row_number().over(order).cast("string")
    return firsts.select(
        "doc_id", "category", "original", F.concat(F.lit("__"), "category", F.lit("_"), number, F.lit("__")).alias("placeholder"))


def line_key(y: Column) -> Column:
    """y on a grid of two points, halves upwards."""
    return (F.floor(y / LINE_GRID + 0.5) * LINE_GRID).cast("int")


def merge_rects(flagged: DataFrame, gap: float = GAP, padding: float = PADDING) -> DataFrame:
    """Neighbouring tokens on a line become one padded rectangle.

    Gaps and islands over (doc, page, line): a token joins while it starts at
    most `gap` after the furthest right edge so far.
    """
    line = ["doc_id", "page", "line"]
    along = Window.partitionBy(*line).orderBy("x", "token_id")
    reach = F.max(F.col("x") + F.col("w")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("x") - reach > gap), 1).otherwise(0)
    return (
        flagged.withColumn("line", line_key(F.col("y")))
        .withColumn("_new", new)
        .withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*line, "_island")
        .agg(
            F.min("x").alias("_left"),
            F.max(F.col("x") + F.col("w")).alias("_right"),
            F.min_by("y", F.struct("x", "token_id")).alias("_y"),
            F.max("h").alias("_h"),
        )
        .select(
            "doc_id",
            "page",
            (F.col("_left") - padding).alias("x"),
            (F.col("_y") - padding).alias("y"),
            (F.col("_right") - F.col("_left") + 2 * padding).alias("w"),
            (F.col("_h") + 2 * padding).alias("h"),
            F.lit(RECT_REASON).alias("reason"),
        )
    )
