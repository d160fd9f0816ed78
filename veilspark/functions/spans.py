"""Column expressions for finding, merging, numbering and replacing spans.

Everything here works inside one row on arrays, so a document is rewritten
without a shuffle.  Offsets are code points (`start`, `end`, end exclusive);
`bstart` and `bend` are the same places in UTF-8 bytes, which let the text be
cut in constant time per piece.  The array steps are written so that a document
with very many hits stays close to linear.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.patterns import (
    BEYOND_LATIN,
    DEFAULT_RULES,
    WIDE_SPACE,
    Rule,
    spark_pattern,
)

SPAN_TYPE = (
    "array<struct<start:int,neg_end:int,priority:int,end:int,bstart:int,bend:int,"
    "category:string,value:string>>"
)
#: Entries up to which a running sum needs no blocks.
SHORT = 8
_OPEN, _CLOSE = "\x01", "\x02"
_MATCH_TYPE = "struct<category:string,priority:int,m:array<string>,g:array<string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _block_size(values: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"))


def _blocks(values: Column, size: Column) -> Column:
    count = F.floor((F.size(values) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(values, b * size + 1, size))


def running_total(values: Column) -> Column:
    """Inclusive running sum of a non-empty int array: one by one if it is short, else by blocks of sqrt(n)."""

    def per_block(blocks: Column, sums: Column) -> Column:
        return F.flatten(
            F.transform(
                blocks,
                lambda block, b: let(
                    _total(F.slice(sums, F.lit(1), b)),
                    lambda base: F.transform(
                        block, lambda _, j: base + _total(F.slice(block, F.lit(1), j + 1))
                    ),
                ),
            )
        )

    return let(
        values,
        lambda a: F.when(
            F.size(a) <= SHORT, F.transform(a, lambda _, i: _total(F.slice(a, F.lit(1), i + 1)))
        ).otherwise(let(
            _blocks(a, _block_size(a)),
            lambda blocks: let(F.transform(blocks, _total), lambda sums: per_block(blocks, sums)),
        )),
    )


def running_max(values: Column) -> Column:
    """Inclusive running maximum of a non-empty array, by blocks of sqrt(n)."""

    def per_block(blocks: Column, tops: Column) -> Column:
        return F.flatten(
            F.transform(
                blocks,
                lambda block, b: let(
                    F.slice(tops, F.lit(1), b),
                    lambda before: let(
                        F.when(F.size(before) > 0, F.array(F.array_max(before))).otherwise(before),
                        lambda base: F.transform(
                            block,
                            lambda _, j: F.array_max(
                                F.concat(base, F.slice(block, F.lit(1), j + 1))
                            ),
                        ),
                    ),
                ),
            )
        )

    return let(
        values,
        lambda a: let(
            _blocks(a, _block_size(a)),
            lambda blocks: let(
                F.transform(blocks, lambda b: F.array_max(b)), lambda tops: per_block(blocks, tops)
            ),
        ),
    )


def groups(values: Column, is_head: Callable[[Column, Column], Column]) -> Column:
    """Cut a sorted array where `is_head(previous, current)` holds."""

    def cut(a: Column) -> Column:
        heads = F.filter(
            F.transform(a, lambda x, i: F.when((i == 0) | is_head(F.get(a, i - 1), x), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            heads,
            lambda h: F.transform(
                h,
                lambda first, j: F.slice(
                    a, first + 1, F.coalesce(F.get(h, j + 1), F.size(a)) - first
                ),
            ),
        )

    return let(values, cut)


def entropy_bits(token: Column) -> Column:
    """Shannon entropy in bits per character, from per-character counts."""

    def bits(chars: Column, size: Column) -> Column:
        shares = F.transform(
            chars,
            lambda c: (size - F.length(F.replace(token, c, F.lit("")))) / size.cast("double"),
        )
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return let(
        F.sort_array(F.array_distinct(F.split(token, "", -1))),
        lambda chars: bits(F.filter(chars, lambda c: c != F.lit("")), F.length(token)),
    )


def _matches(text: Column, rule: Rule, priority: int) -> Column:
    """struct(category, priority, matches, gaps between them).

    One run of the pattern marks the matches with two control characters, and the
    marked text is cut at them; a text that holds such a character itself is run
    through the pattern twice instead.
    """
    wide = F.rlike(text, F.lit(BEYOND_LATIN)) & F.rlike(text, F.lit(WIDE_SPACE))
    exact = F.lit(spark_pattern(rule.pattern))
    plain = F.lit(spark_pattern(rule.plain)) if rule.plain else None

    def by_pattern(use: Callable[[Column], Column]) -> Column:
        return use(exact) if plain is None else F.when(wide, use(exact)).otherwise(use(plain))

    def pair(m: Column, g: Column) -> Column:
        return F.struct(
            F.lit(rule.category).alias("category"), F.lit(priority).alias("priority"), m.alias("m"), g.alias("g")
        ).cast(_MATCH_TYPE)

    def cut(parts: Column) -> Column:
        return pair(
            F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.substring_index(p, _CLOSE, 1)),
            F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.substring_index(p, _CLOSE, -1))),
        )

    marked = by_pattern(lambda regex: F.regexp_replace(text, regex, F.lit(f"{_OPEN}$0{_CLOSE}")))
    holds_marks = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    twice = pair(
        by_pattern(lambda regex: F.regexp_extract_all(text, regex, F.lit(0))),
        by_pattern(lambda regex: F.split(text, regex, -1)),
    )
    found = F.when(holds_marks, twice).otherwise(let(F.split(marked, _OPEN, -1), cut))
    if rule.gate is None:
        return F.when(text.isNotNull(), found)
    return F.when(F.rlike(text, F.lit(spark_pattern(rule.gate))), found)


def _place(hit: Column) -> Column:
    """Offsets of one rule's matches, from the lengths of matches and gaps."""

    def widths(measure: Callable[[Column], Column]) -> Column:
        return running_total(
            F.transform(hit.m, lambda x, i: measure(x) + measure(F.get(hit.g, i)))
        )

    def build(ends: Column, bends: Column) -> Column:
        return F.transform(
            hit.m,
            lambda x, i: F.struct(
                (F.get(ends, i) - F.length(x)).alias("start"),
                (-F.get(ends, i)).alias("neg_end"),
                hit.priority.alias("priority"),
                F.get(ends, i).alias("end"),
                (F.get(bends, i) - F.octet_length(x)).alias("bstart"),
                F.get(bends, i).alias("bend"),
                hit.category.alias("category"),
                x.alias("value"),
            ),
        ).cast(SPAN_TYPE)

    placed = let(
        widths(F.length), lambda ends: let(widths(F.octet_length), lambda bends: build(ends, bends))
    )
    return F.when(F.size(hit.m) > 0, placed).otherwise(F.array().cast(SPAN_TYPE))


def _drop_predictable(spans: Column, priority: int, min_bits: float) -> Column:
    return F.filter(
        spans,
        lambda s: (s.priority != priority) | (F.round(entropy_bits(s.value), 9) >= min_bits),
    )


def may_match(text: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Whether any rule's gate opens; false means that no rule can match.

    Gates whose first characters are known are one pattern: the text is read once for all of them.
    """
    test = F.lit(False)
    if all(rule.gate is not None for rule in rules):
        known = [rule for rule in rules if rule.starts is not None]
        rules = [rule for rule in rules if rule.starts is None]
        if known:
            firsts = "".join(dict.fromkeys(rule.starts for rule in known))
            together = "|".join(dict.fromkeys(spark_pattern(rule.gate) for rule in known))
            test = F.rlike(text, F.lit(f"(?=[{firsts}])(?:{together})"))
    for rule in reversed(rules):
        gate = F.lit(True) if rule.gate is None else F.rlike(text, F.lit(spark_pattern(rule.gate)))
        test = gate | test
    return test


_built: dict[tuple, Column] = {}


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression built for a column name.

    The expression has a few hundred nodes, each made by a call into the JVM; a job
    that uses it on several frames makes it once.  A `Column` argument is built anew.
    """

    @wraps(build)
    def get(text: Column | str, rules: Sequence[Rule] = DEFAULT_RULES, **options) -> Column:
        if not isinstance(text, str):
            return build(text, rules, **options)
        key = (build.__name__, SparkContext._gateway, text, tuple(rules), *options.items())
        if key not in _built:
            _built[key] = build(F.col(text), rules, **options)
        return _built[key]

    return get


@built_once
def find_spans(text: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """All matches of all rules in one pass over a row, sorted by position.

    Spans at exactly the same place keep the rule that comes first in the table.
    The gates are tried first, in generated code; only texts that pass one reach
    the array functions, which are interpreted.
    """
    hits = F.array(*[_matches(text, rule, i) for i, rule in enumerate(rules)])
    spans = F.flatten(F.transform(hits, _place))
    for i, rule in enumerate(rules):
        if rule.min_bits is not None:
            spans = _drop_predictable(spans, i, rule.min_bits)
    found = let(
        F.sort_array(spans),
        lambda s: F.filter(
            s,
            lambda x, i: (i == 0)
            | (x.start != F.get(s, i - 1).start)
            | (x.end != F.get(s, i - 1).end),
        ),
    )
    return F.when(may_match(text, rules), found).otherwise(F.array().cast(SPAN_TYPE))


def merge_spans(spans: Column) -> Column:
    """Join overlapping spans into disjoint ones.

    A merged span keeps the category of its first, then longest, then
    highest-ranked member.  Spans that only touch stay apart.
    """

    def merged(s: Column, reach: Column) -> Column:
        heads = F.filter(
            F.transform(
                s,
                lambda x, i: F.when((i == 0) | (x.start >= F.get(reach, i - 1).end), i),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            heads,
            lambda h: F.transform(
                h,
                lambda first, j: let(
                    F.get(reach, F.coalesce(F.get(h, j + 1), F.size(s)) - 1),
                    lambda last: F.struct(
                        F.get(s, first).start.alias("start"),
                        last.end.alias("end"),
                        F.get(s, first).bstart.alias("bstart"),
                        last.bend.alias("bend"),
                        F.get(s, first).category.alias("category"),
                    ),
                ),
            ),
        )

    empty = F.array().cast("array<struct<start:int,end:int,bstart:int,bend:int,category:string>>")
    return let(
        spans,
        lambda s: F.when(
            F.size(s) > 0,
            let(
                running_max(F.transform(s, lambda x: F.struct(x.end.alias("end"), x.bend.alias("bend")))),
                lambda reach: merged(s, reach),
            ),
        ).otherwise(empty),
    )


def number_spans(spans: Column, text: Column, dedupe: bool = False) -> Column:
    """Give each disjoint span its original text and `__CATEGORY_n__` placeholder.

    n counts per category from left to right; with `dedupe` equal values share
    the number of their first appearance.
    """

    def mark(x: Column, n: Column) -> Column:
        return F.struct(
            x.start.alias("start"),
            x.end.alias("end"),
            x.bstart.alias("bstart"),
            x.bend.alias("bend"),
            x.category.alias("category"),
            x.original.alias("original"),
            F.concat(F.lit("__"), x.category, F.lit("_"), n.cast("string"), F.lit("__")).alias(
                "placeholder"
            ),
        )

    def numbered(raw: Column) -> Column:
        if dedupe:
            by_value = F.sort_array(
                F.transform(
                    raw,
                    lambda x: F.struct(
                        x.category.alias("category"), x.original.alias("original"),
                        x.start.alias("start"), x.end.alias("end"),
                        x.bstart.alias("bstart"), x.bend.alias("bend"),
                    ),
                )
            )
            same_value = groups(
                by_value,
                lambda a, b: (a.category != b.category) | (a.original != b.original),
            )
            firsts = F.sort_array(
                F.transform(
                    same_value,
                    lambda g: F.struct(
                        F.get(g, F.lit(0)).category.alias("category"),
                        F.get(g, F.lit(0)).start.alias("start"),
                        g.alias("members"),
                    ),
                )
            )
            per_category = groups(firsts, lambda a, b: a.category != b.category)
            marks = F.transform(
                per_category,
                lambda c: F.flatten(
                    F.transform(c, lambda v, i: F.transform(v.members, lambda x: mark(x, i + 1)))
                ),
            )
        else:
            by_category = F.sort_array(
                F.transform(
                    raw,
                    lambda x: F.struct(
                        x.category.alias("category"), x.start.alias("start"), x.end.alias("end"),
                        x.bstart.alias("bstart"), x.bend.alias("bend"),
                        x.original.alias("original"),
                    ),
                )
            )
            marks = F.transform(
                groups(by_category, lambda a, b: a.category != b.category),
                lambda c: F.transform(c, lambda x, i: mark(x, i + 1)),
            )
        return F.sort_array(F.flatten(marks))

    empty = F.array().cast(
        "array<struct<start:int,end:int,bstart:int,bend:int,category:string,"
        "original:string,placeholder:string>>"
    )
    with_text = lambda s: let(
        text.cast("binary"),
        lambda raw: F.transform(
            s,
            lambda x: F.struct(
                x.start.alias("start"), x.end.alias("end"),
                x.bstart.alias("bstart"), x.bend.alias("bend"), x.category.alias("category"),
                F.substr(raw, x.bstart + 1, x.bend - x.bstart).cast("string").alias("original"),
            ),
        ),
    )
    return let(
        spans, lambda s: F.when(F.size(s) > 0, numbered(with_text(s))).otherwise(empty)
    )


def replace_spans(text: Column, spans: Column, replacement: str = "placeholder") -> Column:
    """Rebuild the text around sorted, disjoint spans; no spans leaves it as it is."""

    def rebuild(s: Column, raw: Column) -> Column:
        pieces = F.transform(
            s,
            lambda x, i: let(
                F.coalesce(F.get(s, i - 1).bend, F.lit(0)),
                lambda at: F.concat(
                    F.substr(raw, at + 1, x.bstart - at).cast("string"), x[replacement]
                ),
            ),
        )
        last = F.get(s, F.size(s) - 1).bend
        tail = F.substr(raw, last + 1, F.octet_length(raw) - last).cast("string")
        return F.concat(F.array_join(pieces, ""), tail)

    return let(
        spans,
        lambda s: F.when(
            F.size(s) > 0, let(text.cast("binary"), lambda raw: rebuild(s, raw))
        ).otherwise(text),
    )
