"""Personal data: generators propose, boosted trees score, calibrated thresholds select; DataFrame functions only.

1. Fixed patterns with their checks give the base spans, which always stay.
2. Generators propose many more, overlapping spans: anything around an @, numbers in groups, bare
   numbers, dotted numbers, account numbers.  Each gets features of its format (digits, groups, separators,
   letters) and of its context (the characters on both sides, cue words before it, other digits near it), up to the
   neighbouring candidate of its generator.  A candidate is verified if its text passes a check (checksum, range, number
   of digits behind a plus sign, full address); no feature tells what a check looks at.
3. Candidates are counted per generator, features, verification and fold.  Trees of depth `DEPTH` are
   boosted on the counts of two folds of three (a text's fold is a hash of it, so that copies stay together): gradients
   and Hessians are summed per leaf, feature and value in Spark, and splits chosen from these sums.
   So the model says how often candidates that look and stand like this one pass the check.
4. On the third fold scores are calibrated per generator: score bins give shares of verified candidates, made
   monotone.  The threshold is the least bin with a share of `MIN_PRECISION` or more.  Candidates beyond it that
   fail the check (a card number with a wrong digit where nearly all such numbers are right) are added.
5. Added spans that overlap are joined; those that overlap a base span, or a chain of spans that leads to one, give way to it.

Texts are read once and never shuffled; spans and candidates are stored.  To the driver come sums per (leaf,
feature, value) and per (generator, score bin), whose numbers are fixed by the parameters.  The fit uses at most
`MAX_CELLS` distinct combinations of features (all of them if there are fewer); thresholds use all candidates.

Defined results: a null or empty text has no spans; texts of any length are scanned whole; repeated rows
get equal answers; ids are carried, null ones too; other columns are not read; an empty table gives no rows; where
too few candidates of a generator are verified (`MIN_VERIFIED`), it adds nothing.
"""
from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import let, running_max, running_total
from veilspark.llm.common import materialize, whole

#: Base kinds in order, and generators, each with the pattern of its spans and a pattern that a text must hold.
#: A pattern that starts at the start of a run finds what one that may start inside it finds, without trying each place.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
GENERATORS = (
    ("address", r"(?<![^\s@<>\x22'(),;:])[^\s@<>\x22'(),;:]++@[^\s@<>\x22'(),;:]++", "@"),
    ("grouped", r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++", r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"),
    ("number", r"[0-9]{9,}+", r"[0-9]{9}"),
    ("dotted", r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+", r"[0-9]\.[0-9]++\.[0-9]"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){8,}+", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
)
#: Words that stand before personal data and before other numbers.
CUES = r"(?i)(mail|phone|tel|call|fax|mobil|card|visa|karte|tarjeta|carte|iban|konto|ssn|contact|host|server|addr)"
OTHER_CUES = r"(?i)(version|order|invoice|isbn|issn|page|ref|build|release|chapter|rfc|doi)"
CONTEXT = 24
FEATURES = ("digits", "groups", "longest", "separators", "letters", "distinct", "dots", "before", "after", "cue", "near", "first")
TREES, DEPTH, RATE, SMOOTH = 12, 3, 0.5, 2.0
#: Candidates that a leaf holds at least; fewer say little about a new one.
MIN_LEAF = 30
MAX_CELLS = 200_000
BINS = 50
MIN_PRECISION, MIN_VERIFIED = 0.95, 20

_SPAN = "array<struct<start:int,kind:int,end:int>>"
_PLACED = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
_CANDIDATE = f"array<struct<start:int,end:int,kind:int,verified:boolean,{','.join(f'{f}:int' for f in FEATURES)}>>"


# --- spans and checks ----------------------------------------------------------------------------


def _placed(text: Column, pattern: str, gate: str) -> Column:
    """Every match with its place, and the text on both sides of it up to the next match."""
    p = F.lit(pattern)

    def place(found: Column) -> Column:
        ends = running_total(F.transform(found.m, lambda x, i: F.length(x) + F.length(F.get(found.g, i))))
        return let(ends, lambda e: F.transform(found.m, lambda x, i: F.struct(
            (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("value"),
            F.right(F.get(found.g, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(found.g, i + 1), F.lit(CONTEXT)).alias("after"))))

    both = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    placed = let(both, lambda found: F.when(F.size(found.m) > 0, place(found)).otherwise(F.array().cast(_PLACED)))
    opened = F.contains(text, F.lit(gate)) if gate == "@" else F.rlike(text, F.lit(gate))
    return F.when(opened, placed.cast(_PLACED)).otherwise(F.array().cast(_PLACED))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits is right."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.filter(F.split(F.reverse(digits), "", -1), lambda c: c != "")
    worth = F.transform(each, lambda c, i: let(F.ascii(c) - 48, lambda d: F.when(i % 2 == 1, doubled(d)).otherwise(d)))
    return F.aggregate(worth, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _is_card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))


def _is_ip(value: Column) -> Column:
    part = lambda p: F.rlike(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.forall(F.split(value, r"\.", -1), part)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _is_account(value: Column) -> Column:
    """Whether an account number's remainder by 97 is 1, letters counting from 10 and the first four behind."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = let(bare, lambda b: F.concat(F.substr(b, F.lit(5), F.length(b)), F.left(b, F.lit(4))))
    worth = lambda c: F.when(F.rlike(c, F.lit("[0-9]")), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, "", -1), lambda c: c != ""), F.lit(0), lambda acc, c: let(
        worth(c), lambda w: F.when(w > 9, acc * 100 + w).otherwise(acc * 10 + w) % 97))
    return F.when(F.length(bare).between(15, 34), rest == 1).otherwise(F.lit(False))


_BASE_CHECKS = {"email": lambda v: F.lit(True), "ip": _is_ip, "card": _is_card, "phone": _is_phone}


def _verified(kind: str, value: Column) -> Column:
    """Whether a candidate passes one of the checks that its generator's texts can pass."""
    full = lambda name: F.rlike(value, F.lit("^(?:" + next(p for n, p, _ in BASE if n == name) + ")$"))
    card = F.when(full("card"), _is_card(value)).otherwise(F.lit(False))
    if kind == "address":
        return full("email")
    if kind == "grouped":
        return F.when(full("phone"), _is_phone(value)).otherwise(card) | F.when(full("ip"), _is_ip(value)).otherwise(F.lit(False))
    if kind == "dotted":
        return F.when(full("ip"), _is_ip(value)).otherwise(F.lit(False))
    return _is_account(value) if kind == "account" else card


def _passing(check):
    return lambda s: check(s["value"])


def _as_span(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """Spans of the fixed kinds that pass their checks, sorted by start and kind."""
    parts = []
    for k, (name, pattern, gate) in enumerate(BASE):
        good = F.filter(_placed(text, pattern, gate), _passing(_BASE_CHECKS[name]))
        parts.append(F.transform(good, _as_span(k)).cast(_SPAN))
    return F.array_sort(F.concat(*parts))


def _side(c: Column) -> Column:
    """The class of a neighbouring character: none, white space, letter, digit, quote or bracket, other."""
    tests = ((r"^\s$", 1), (r"^[\p{L}]$", 2), (r"^[0-9]$", 3), (r"^[\x22'<>()\[\]{}]$", 4))
    out = F.when(c == "", 0)
    for pattern, k in tests:
        out = out.when(F.rlike(c, F.lit(pattern)), k)
    return out.otherwise(5)


def _features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    count = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, F.lit(pattern), F.lit("")))
    runs = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    digits = _digits(value)
    return {
        "digits": F.least(F.length(digits), F.lit(20)),
        "groups": F.least(F.size(runs), F.lit(8)),
        "longest": F.least(F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)), F.lit(20)),
        "separators": F.least(count(r"[\x20()-]"), F.lit(6)),
        "letters": F.least(count(r"[A-Za-z]"), F.lit(12)),
        "distinct": F.size(F.array_distinct(F.split(digits, "", -1))),
        "dots": F.least(count(r"\."), F.lit(6)),
        "before": _side(F.right(before, F.lit(1))),
        "after": _side(F.left(after, F.lit(1))),
        "cue": F.when(F.rlike(before, F.lit(CUES)), 2).when(F.rlike(before, F.lit(OTHER_CUES)), 0).otherwise(1),
        "near": F.least(F.length(_digits(F.concat(before, after))), F.lit(6)),
        "first": F.ascii(digits) - 47,
    }


def _as_candidate(kind: int, name: str):
    def candidate(s: Column) -> Column:
        columns = _features(s["value"], s["before"], s["after"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), _verified(name, s["value"]).alias("verified"),
                        *[F.greatest(columns[f], F.lit(0)).cast("int").alias(f) for f in FEATURES])

    return candidate


def candidates(text: Column) -> Column:
    """All generators' spans with their features."""
    parts = []
    for k, (name, pattern, gate) in enumerate(GENERATORS):
        parts.append(F.transform(_placed(text, pattern, gate), _as_candidate(k, name)).cast(_CANDIDATE))
    return F.concat(*parts)


# --- boosted trees over counts -------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Trees as tuples (feature, value, left, right) with numbers as leaves, and a threshold per generator."""

    base: float
    trees: tuple
    thresholds: dict[int, int]


def _tree(node, get) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, value, left, right = node
    return F.when(get(feature) <= value, _tree(left, get)).otherwise(_tree(right, get))


def margin(model: Model, get) -> Column:
    """The sum of all trees for one candidate; `get` gives the column of a feature."""
    out = F.lit(float(model.base))
    for tree in model.trees:
        out = out + _tree(tree, get)
    return out


def probability(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def _leaf(node, get, path: int = 1) -> Column:
    """The number of the leaf that a candidate falls in; the children of leaf p are 2p and 2p + 1."""
    if not isinstance(node, tuple):
        return F.lit(path)
    feature, value, left, right = node
    return F.when(get(feature) <= value, _leaf(left, get, 2 * path)).otherwise(_leaf(right, get, 2 * path + 1))


def best_splits(sums: list[tuple], min_leaf: int = MIN_LEAF) -> dict[int, tuple]:
    """leaf -> (gain, feature, value, left weight, right weight), from rows (leaf, feature, value, g, h, n).

    Features are tried in order; of equal gains the first stays.
    """
    by_leaf: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for leaf, feature, value, *sums_ in sums:
        by_leaf[leaf][feature].append((value, *sums_))
    worth = lambda g, h: g * g / (h + SMOOTH)
    out = {}
    for leaf, features in by_leaf.items():
        all_g, all_h, all_n = (sum(x[i] for x in features[0]) for i in (1, 2, 3))
        best = (1e-9, -1, 0, 0.0, 0.0)
        for feature in sorted(features):
            g, h, n = 0.0, 0.0, 0
            for value, more_g, more_h, more_n in sorted(features[feature])[:-1]:
                g, h, n = g + more_g, h + more_h, n + more_n
                gain = worth(g, h) + worth(all_g - g, all_h - h) - worth(all_g, all_h)
                if min(n, all_n - n) >= min_leaf and gain > best[0] + 1e-12:
                    best = (gain, feature, value, -RATE * g / (h + SMOOTH), -RATE * (all_g - g) / (all_h - h + SMOOTH))
        if best[1] >= 0:
            out[leaf] = best
    return out


def _grown(node, splits: dict[int, tuple], names, path: int = 1):
    if isinstance(node, tuple):
        feature, value, left, right = node
        return (feature, value, _grown(left, splits, names, 2 * path), _grown(right, splits, names, 2 * path + 1))
    if path not in splits:
        return node
    _, feature, value, left, right = splits[path]
    return (names[feature], value, left, right)


def fit_trees(cells: DataFrame) -> Model:
    """Boost on counted candidates: columns kind, features, n (candidates) and good (verified ones)."""
    names = ("kind", *FEATURES)
    total = cells.agg(F.sum("n"), F.sum("good")).first()
    if not total[0] or not 0 < total[1] < total[0]:
        return Model(0.0, (), {})
    model = Model(math.log(total[1] / (total[0] - total[1])), (), {})
    for _ in range(TREES):
        tree = 0.0
        p = probability(margin(model, F.col))
        for _ in range(DEPTH):
            at = cells.select(_leaf(tree, F.col).alias("leaf"), (F.col("n") * p - F.col("good")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), "n",
                              F.posexplode(F.array(*names)).alias("feature", "value"))
            sums = at.groupBy("leaf", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
            splits = best_splits([tuple(r) for r in sums])
            if not splits:
                break
            tree = _grown(tree, splits, names)
        if not isinstance(tree, tuple):
            break
        model = Model(model.base, (*model.trees, tree), {})
    return model


def _bin(model: Model, get) -> Column:
    return F.least(F.floor(probability(margin(model, get)) * BINS), F.lit(BINS - 1)).cast("int")


def calibrated(bins: list[tuple[int, int, int]], least: int = MIN_VERIFIED) -> dict[int, float]:
    """bin -> share of verified candidates, not falling from bin to bin (pool adjacent violators).

    `bins` holds (bin, candidates, verified ones).  From the highest bin down, neighbours are put together
    until they hold `least` candidates, so that no share rests on fewer (but the lowest one's).
    """
    together: list[list] = []
    for b, n, good in sorted(bins, reverse=True):
        if together and together[-1][0] < least:
            together[-1] = [together[-1][0] + n, together[-1][1] + good, together[-1][2] + [b]]
        else:
            together.append([n, good, [b]])
    pools: list[list] = []
    for pool in reversed(together):
        pools.append(pool)
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, good, members = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + good, pools[-1][2] + members]
    return {b: good / n for n, good, members in pools for b in members}


def thresholds(model: Model, cells: DataFrame, min_precision: float) -> dict[int, int]:
    """generator -> the least score bin whose calibrated share of verified candidates is high enough."""
    rated = cells.groupBy("kind", _bin(model, F.col).alias("bin")).agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
    out: dict[int, int] = {}
    for kind in sorted({r.kind for r in rated}):
        bins = [(r.bin, r.n, r.good) for r in rated if r.kind == kind]
        least = min((b for b, share in calibrated(bins).items() if share >= min_precision), default=None)
        if least is not None and sum(good for b, _, good in bins if b >= least) >= MIN_VERIFIED:
            out[kind] = least
    return out


def fit(found: DataFrame, min_precision: float) -> Model:
    """A model from stored candidates (columns `held` and `candidates`)."""
    one = found.select("held", F.explode("candidates").alias("c")).select("held", "c.*")
    cells = one.groupBy("held", "kind", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("good"))
    cells = materialize(cells, "pii_cells")
    bounded = cells.where("NOT held").orderBy(F.xxhash64("kind", *FEATURES), "kind", *FEATURES).limit(MAX_CELLS)
    # at most MAX_CELLS narrow rows, read once per level: one partition spares every level its shuffle
    bounded = materialize(bounded, "pii_fit").coalesce(1)
    model = fit_trees(bounded)
    return Model(model.base, model.trees, thresholds(model, cells.where("held"), min_precision))


# --- selection -----------------------------------------------------------------------------------


def resolved(spans: Column) -> Column:
    """Islands of overlapping spans: those with a base span keep their base spans, others become one span."""
    base = lambda s: s["kind"] < len(BASE)

    def islands(s: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
        return let(heads, lambda h: F.transform(h, lambda first, j: F.slice(s, first + 1, F.coalesce(F.get(h, j + 1), F.size(s)) - first)))

    def settle(island: Column) -> Column:
        kept = F.filter(island, base)
        joined = F.array(F.struct(F.get(island, F.lit(0))["start"].alias("start"), F.get(island, F.lit(0))["kind"].alias("kind"),
                                  F.array_max(F.transform(island, lambda x: x["end"])).alias("end")))
        return F.when(F.size(kept) > 0, kept).otherwise(joined.cast(_SPAN))

    whole_ = let(spans, lambda s: let(running_max(F.transform(s, lambda x: x["end"])), lambda reach: F.flatten(F.transform(islands(s, reach), settle))))
    return F.when(F.size(spans) > 0, whole_).otherwise(spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_precision: float = MIN_PRECISION) -> DataFrame:
    """One row per document: its id, `base` spans and all `spans`, as arrays of struct(start, kind, end).

    `kind` is a place in `BASE`, or `len(BASE)` plus a place in `GENERATORS`.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole(F.col(f"`{text_col}`")).alias("text"))
    found = materialize(rows.select(
        "doc_id", (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("held"), base_spans(F.col("text")).alias("base"),
        F.when(F.rlike("text", F.lit("[0-9@]")), candidates(F.col("text"))).otherwise(F.array().cast(_CANDIDATE)).alias("candidates")), "pii")
    model = fit(found, min_precision)
    if not model.thresholds:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    limit = F.create_map(*[F.lit(x) for kv in sorted(model.thresholds.items()) for x in kv])
    passes = lambda c: ~c["verified"] & F.coalesce(_bin(model, lambda f: c[f]) >= F.try_element_at(limit, c["kind"]), F.lit(False))
    added = F.transform(F.filter("candidates", passes), lambda c: F.struct(
        c["start"].alias("start"), (c["kind"] + len(BASE)).cast("int").alias("kind"), c["end"].alias("end"))).cast(_SPAN)
    spans = F.when(F.size(added) > 0, let(F.array_sort(F.concat("base", added)), resolved)).otherwise(F.col("base"))
    return found.select("doc_id", "base", spans.alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*BASE, *GENERATORS)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: base spans per kind, their digest, all spans as text, and how many were added."""
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return scan(docs, **options).select(
        "doc_id", *[count(_of_kind(k)).alias(f"n_{kind[0]}") for k, kind in enumerate(BASE)],
        F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"),
        count(lambda s: s["kind"] >= len(BASE)).alias("n_added"))


def redact(docs: DataFrame, *, text_col: str = "text", out_col: str = "redacted", **options) -> DataFrame:
    """(doc_id, `out_col`, spans): every document's text with its spans replaced by the name of their kind."""
    id_col = options.pop("id_col", "doc_id")
    marked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(whole(F.col(f"`{text_col}`"))).alias("text_hash"), whole(F.col(f"`{text_col}`")).alias("text"))
    found = scan(marked.select(F.struct("doc_id", "text_hash").alias("key"), "text"), id_col="key", **options)
    spans = found.select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.text_hash").alias("hash"), "spans").dropDuplicates(["id", "hash"])
    names = F.array(*[F.lit(k[0]) for k in (*BASE, *GENERATORS)])

    def cut(s: Column, raw: Column) -> Column:
        # four bytes a character: pieces are cut in constant time
        part = lambda at, to: F.decode(F.substr(raw, 4 * at + 1, 4 * (to - at)), "UTF-32")
        reach = F.transform(s, lambda x: x["end"])
        piece = lambda e: F.transform(s, lambda x, i: let(F.coalesce(F.get(e, i - 1), F.lit(0)), lambda at: F.when(
            x["start"] >= at, F.concat(part(at, x["start"]), F.lit("["), F.get(names, x["kind"]), F.lit("]"))).otherwise("")))
        return let(running_max(reach), lambda e: F.concat(F.array_join(piece(e), ""), part(F.array_max(e), F.floor(F.octet_length(raw) / 4).cast("int"))))

    joined = marked.join(spans, marked.doc_id.eqNullSafe(spans.id) & (marked.text_hash == spans.hash))
    return joined.select("doc_id", F.when(F.size("spans") > 0, let(F.encode("text", "UTF-32"), lambda raw: cut(F.col("spans"), raw))).otherwise(F.col("text")).alias(out_col), "spans")
