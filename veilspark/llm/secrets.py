"""Secret scan: fixed patterns, and a randomness test battery over other long tokens.

Patterns are found leftmost and without overlaps per kind.  Every other run of 20 or more token
characters that holds a digit and a letter is a candidate.  Its encoding is inferred from its
characters, and three tests are made of the hypothesis that its symbols are drawn evenly and
independently: chi-squared uniformity over the alphabet (as the number of equal pairs, whose mean and
variance hold for short tokens too), runs above and below the middle of the alphabet, and
serial correlation of neighbours.  Their combined p-value, 1 - (1 - least)^3, is low for
structured tokens (paths, identifiers, counters) and spread nearly evenly for random ones.

How low is too low depends on the length: a short token says little.  So for each encoding and
length band the p-values of the whole corpus are counted; those above one fifth, over the share of
random tokens that lie there (`UPPER_SHARE`), tell how many random tokens there are, and the least threshold is taken at which the expected share of
structured tokens among the reported ones is at most `max_fdr`.  A band that allows no
threshold reports nothing.

All of it is DataFrame functions.  Texts are read once and never shuffled; what the second step
needs (spans and p-values) is stored.  To the driver come the thresholds: one row per
encoding and band, `len(ALPHABETS) * len(BANDS)` at most.

Defined results: a null or empty text has no spans; texts of any length are scanned whole; rows
are independent but for the thresholds, and repeated rows get equal answers; ids are carried,
null ones too; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.spans import let, running_total
from veilspark.llm.common import materialize, whole

#: Fixed: the kinds in order, their patterns, the group that must have a least length, and that length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: A match that is long enough holds this; where a text does not, the kind is not looked for.
GATES = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
RANDOM = "random"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
CANDIDATE_GATE = r"[A-Za-z0-9+/_-]{20}"
_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding: pattern of its tokens and its alphabet; the first that fits is inferred.
ALPHABETS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hexupper", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base62", r"^[A-Za-z0-9]+$", _UPPER + _UPPER.lower() + _DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+=*$", _UPPER + _UPPER.lower() + _DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", _UPPER + _UPPER.lower() + _DIGITS + "-_"),
)
BANDS = (20, 24, 32, 48, 64, 96, 128, 256)
#: Tokens with a combined p-value from this bin on tell how many random tokens there are.
UPPER = 20
#: Shares of random tokens at or above it, by size of the alphabet and length band: measured on
#: 32,000 random tokens each, lengths even over the band (the last one up to 383).  They are not
#: 0.8, since the tests are neither independent nor continuous.
UPPER_SHARE = {
    16: (0.844, 0.847, 0.838, 0.838, 0.835, 0.835, 0.834, 0.832),
    32: (0.835, 0.836, 0.836, 0.833, 0.830, 0.833, 0.829, 0.827),
    62: (0.837, 0.842, 0.835, 0.829, 0.830, 0.829, 0.827, 0.823),
    64: (0.844, 0.844, 0.833, 0.829, 0.830, 0.824, 0.823, 0.823),
}
BINS = 100
MAX_FDR = 0.05
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_TOKEN = "array<struct<start:int,end:int,value:string>>"
_JUDGED = "array<struct<start:int,end:int,encoding:int,band:int,p:double>>"


def _placed(text: Column, pattern: str) -> Column:
    """Every match of the pattern with its place, from the lengths of matches and gaps."""
    p = F.lit(pattern)

    def place(found: Column) -> Column:
        ends = running_total(F.transform(found.m, lambda x, i: F.length(x) + F.length(F.get(found.g, i))))
        return let(ends, lambda e: F.transform(found.m, lambda x, i: F.struct(
            (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("value"))))

    both = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return let(both, lambda found: F.when(F.size(found.m) > 0, place(found)).otherwise(F.array().cast(_TOKEN)))


def base_spans(text: Column) -> Column:
    """Spans of the fixed kinds, sorted by start and kind."""
    parts = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        spans = F.transform(F.filter(_placed(text, pattern), _long(pattern, group, least)), _as_span(k))
        parts.append(F.when(F.rlike(text, F.lit(GATES[name])), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*parts))


def _long(pattern: str, group: int, least: int):
    """Whether a match's group has the least length."""
    if group == 0:
        return lambda s: F.length(s["value"]) >= least
    return lambda s: F.length(F.regexp_extract(s["value"], pattern, group)) >= least


def _as_span(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution for z >= 0, by a polynomial good to 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly


def _two_sided(z: Column) -> Column:
    return let(F.abs(z), lambda a: F.when(a > 38, F.lit(0.0)).otherwise(2 * upper_tail(a)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def battery(codes: Column, k: int) -> Column:
    """The combined p-value of a token's symbol numbers under even, independent draws from k symbols."""

    def test(c: Column) -> Column:
        n = F.size(c).cast("double")
        counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.size(F.filter(c, lambda x: x == s)).cast("double"))
        pairs = _sum(F.transform(counts, lambda x: x * (x - 1) / 2))
        mean, var = n * (n - 1) / (2 * k), n * (n - 1) / 2 * (1 / k) * (1 - 1 / k)
        even = _two_sided((pairs - mean) / F.sqrt(var))
        high = F.transform(c, lambda x: (x >= k / 2).cast("int"))

        def runs(h: Column) -> Column:
            n1 = F.aggregate(h, F.lit(0), lambda acc, x: acc + x).cast("double")
            changes = F.aggregate(F.transform(h, lambda x, i: F.when((i > 0) & (F.get(h, i - 1) != x), 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
            two = 2 * n1 * (n - n1)
            spread = two * (two - n) / (n * n * (n - 1))
            # without spread all symbols are on one side (or all but one): not random
            return F.when(spread <= 0, F.lit(0.0)).otherwise(_two_sided((changes + 1 - two / n - 1) / F.sqrt(F.greatest(spread, F.lit(1e-12)))))

        def serial(m: Column) -> Column:
            dev = F.transform(c, lambda x: x.cast("double") - m)
            square = _sum(F.transform(dev, lambda x: x * x))
            lag = _sum(F.transform(dev, lambda x, i: F.when(i > 0, x * F.get(dev, i - 1)).otherwise(F.lit(0.0))))
            return F.when(square <= 0, F.lit(0.0)).otherwise(_two_sided((lag / F.greatest(square, F.lit(1e-12)) + 1 / n) * F.sqrt(n)))

        mean_code = _sum(F.transform(c, lambda x: x.cast("double"))) / n
        return 1 - F.pow(1 - F.least(F.lit(1.0), even, let(high, runs), let(mean_code, serial)), F.lit(3))

    return let(codes, test)


def _codes(value: Column, alphabet: str) -> Column:
    body = F.split(F.rtrim(value, F.lit("=")), "", -1)
    return F.transform(F.filter(body, lambda c: c != ""), lambda c: F.call_function("instr", F.lit(alphabet), c) - 1)


def _judge(token: Column) -> Column:
    """struct(start, end, encoding, band, p); encoding -1 if none fits."""
    value = token["value"]
    encoding, p = F.lit(-1), F.lit(0.0)
    for k in reversed(range(len(ALPHABETS))):
        _, pattern, alphabet = ALPHABETS[k]
        fits = F.rlike(value, F.lit(pattern))
        encoding = F.when(fits, F.lit(k)).otherwise(encoding)
        p = F.when(fits, battery(_codes(value, alphabet), len(alphabet))).otherwise(p)
    size = F.length(value)
    band = F.lit(0)
    for k, least in enumerate(BANDS):
        band = F.when(size >= least, F.lit(k)).otherwise(band)
    return F.struct(token["start"].alias("start"), token["end"].alias("end"), encoding.alias("encoding"), band.alias("band"), p.alias("p"))


def candidates(text: Column, base: Column) -> Column:
    """Judged tokens that overlap no base span."""
    mixed = lambda s: F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Za-z]"))
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    tokens = F.filter(F.filter(_placed(text, CANDIDATE), mixed), free)
    judged = F.filter(F.transform(tokens, _judge), lambda j: j["encoding"] >= 0).cast(_JUDGED)
    return F.when(F.rlike(text, F.lit(CANDIDATE_GATE)), judged).otherwise(F.array().cast(_JUDGED))


def thresholds(found: DataFrame, max_fdr: float) -> DataFrame:
    """(encoding, band, bin): the least p-value bin from which on tokens are reported.

    In a band, F(t) tokens have p >= t.  W tokens have p >= 1/5, so there are about W / share random
    ones, of which at least 1 - t have p >= t; the rest of F(t) is the expected number of false discoveries.
    """
    one = found.select(F.explode("tokens").alias("t")).select("t.encoding", "t.band", F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counted = one.groupBy("encoding", "band", "bin").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("encoding", "band")
    above = group.orderBy(F.col("bin").desc())
    rated = counted.select(
        "encoding", "band", "bin", F.sum("c").over(above).alias("f"),
        F.sum(F.when(F.col("bin") >= UPPER, F.col("c")).otherwise(0)).over(group).alias("w"))
    shares = F.array(*[F.lit(x) for _, _, alphabet in ALPHABETS for x in UPPER_SHARE[len(alphabet)]])
    random = F.col("w") / F.get(shares, F.col("encoding") * len(BANDS) + F.col("band")) * (1 - F.col("bin") / BINS)
    ok = rated.where((F.col("w") > 0) & (F.col("bin") > 0) & (1 - random / F.col("f") <= max_fdr))
    return ok.groupBy("encoding", "band").agg(F.min("bin").alias("bin"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_fdr: float = MAX_FDR) -> DataFrame:
    """One row per document: its id, `base` spans and all `spans`, as arrays of struct(start, kind, end).

    `kind` is a place in `KINDS`, or `len(KINDS)` for a random token.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole(F.col(f"`{text_col}`")).alias("text"))
    found = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    found = materialize(found.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("tokens")), "secrets")
    limits = {(r.encoding, r.band): r.bin for r in thresholds(found, max_fdr).collect()}
    if limits:
        entries = [x for (e, b), least in sorted(limits.items()) for x in (F.lit(e * len(BANDS) + b), F.lit(least / BINS))]
        limit = F.create_map(*entries)
        passed = F.filter("tokens", lambda t: F.coalesce(t["p"] >= F.try_element_at(limit, t["encoding"] * len(BANDS) + t["band"]), F.lit(False)))
    else:
        passed = F.filter("tokens", lambda t: F.lit(False))
    added = F.transform(passed, _as_span(len(KINDS))).cast(_SPAN)
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: spans per kind, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, **options).select(
        "doc_id",
        *[count(k).alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)],
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
        count(len(KINDS)).alias("n_random"),
    )
