"""Base spans against the plain patterns; model, thresholds and selection against loops over all candidates."""
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm import pii as P

KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    worth = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(w - 9 if w > 9 else w for w in worth) % 10 == 0


def base(text):
    """The contract's patterns, tried at every place."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for k, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (k == 3 or luhn(digits)):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    parts = ["a@b.c", "x.y_z%+-@h-1.de", "@", ".", "é", "😀", " ", "\n", "_", "+", "1", "255.0.1.2", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "79927398713", "+1 (017) 555-7713", "+44 20 7946 0958 ", "+1", "((", "99999999999999999999999", "- -", "a@b", "c@d.e@f.g", "123456789012345"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kind int, base string")


def test_base_spans_equal_the_patterns(spark):
    texts = made(1) + ["", None, "a" * 30_000, "1 " * 20_000, "+1" + " " * 20_000, "a.b@c.d" * 2000, "1.2.3.4 " * 1000]
    got = {r.doc_id: r for r in P.pii_report(frame(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = base(text or "")
        written = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), text and text[:80]
        assert tuple(got[i][f"n_{k}"] for k in KINDS) == tuple(sum(x[1] == j for x in want) for j in range(4))
        have = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in have if s.split(":")[0] in KINDS] == written.split(",") if written else not [s for s in have if s.split(":")[0] in KINDS]


def test_generators_equal_their_patterns(spark):
    texts = made(2, 150)
    df = frame(spark, list(enumerate(texts))).select("doc_id", F.explode(P.candidates(F.col("text"))).alias("c")).select("doc_id", "c.*")
    got = Counter((r.doc_id, r.kind, r.start, r.end) for r in df.collect())
    want = Counter((i, k, m.start(), m.end()) for i, t in enumerate(texts) for k, (_, p, _) in enumerate(P.GENERATORS) for m in re.finditer(p, t))
    # a generator's gate may leave out short numbers, which no check takes
    assert not got - want and all(sum(c.isdigit() for c in texts[i][s:e]) < 9 for i, k, s, e in want - got if k != 0) and not [x for x in want - got if x[1] == 0]


def number(rng, good):
    while True:
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(digits) == good:
            return digits


def corpus(share_wrong=0.02, n=600, seed=3):
    """Card numbers behind a cue, nearly all of them right; order numbers, mostly wrong; both of one format."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        wrong = rng.random() < share_wrong
        card = number(rng, not wrong)
        rows.append((i, f"line {i}x says card {card} and order {number(rng, rng.random() < 0.1)} goes", wrong, card))
    return rows


def test_added_spans_are_those_like_verified_ones(spark):
    rows = corpus()
    got = {r.doc_id: r.spans for r in P.pii_report(frame(spark, [r[:2] for r in rows])).collect()}
    wrong = [r for r in rows if r[2]]
    caught = 0
    for i, text, bad, card in rows:
        at = text.index("card ") + 5
        added = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s and s.split(":")[0] not in KINDS]
        assert added in ([], [(at, at + 16)] if bad else []), (text, got[i])
        caught += bool(added)
    assert len(wrong) >= 5 and caught >= 0.8 * len(wrong)


def _value(node, features):
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


def test_model_and_thresholds_equal_loops(spark):
    rows = [r[:2] for r in corpus(0.3)] + [(1000 + i, t) for i, t in enumerate(made(4))]
    found = frame(spark, rows).select("doc_id", "text", (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("held"), P.candidates(F.col("text")).alias("candidates"))
    found = P.materialize(found, "found")
    model = P.fit(found, 0.8)
    assert len(model.trees) == P.TREES
    one = found.select("held", F.explode("candidates").alias("c")).select("held", "c.*")
    scored = one.select("held", *["kind", "verified", *P.FEATURES], P.margin(model, F.col).alias("m"), P._bin(model, F.col).alias("bin")).collect()
    bins = {}
    for r in scored:
        features = {f: r[f] for f in ("kind", *P.FEATURES)}
        assert r.m == pytest.approx(model.base + sum(_value(t, features) for t in model.trees))
        if r.held:
            bins.setdefault(r.kind, []).append((r.bin, r.verified))
    for kind in range(len(P.GENERATORS)):
        held = bins.get(kind, [])
        # bins from the top, twenty candidates together at least
        members, size, pool = {}, 0, 0
        for b in sorted({b for b, _ in held}, reverse=True):
            members[b] = pool
            size += sum(x == b for x, _ in held)
            if size >= P.MIN_VERIFIED:
                size, pool = 0, pool + 1
        table = [(-q, sum(members[x] == q for x, _ in held), sum(v for x, v in held if members[x] == q)) for q in sorted(set(members.values()), reverse=True)]
        # the monotone fit by its min-max formula
        pooled = {b: max(min(sum(g for c, _, g in table if a <= c <= z) / sum(n for c, n, _ in table if a <= c <= z) for z, *_ in table if z >= b)
                         for a, *_ in table if a <= b) for b, *_ in table}
        share = {b: pooled[-q] for b, q in members.items()}
        least = min((b for b, s in share.items() if s >= 0.8), default=None)
        enough = least is not None and sum(v for b, v in held if b >= least) >= P.MIN_VERIFIED
        assert model.thresholds.get(kind) == (least if enough else None)
    # boosting lowers the loss of the rows it is fitted to
    fit_rows = [r for r in scored if not r.held]
    import math

    loss = lambda m, y: math.log1p(math.exp(-m if y else m))
    assert sum(loss(r.m, r.verified) for r in fit_rows) < 0.6 * sum(loss(model.base, r.verified) for r in fit_rows)


def test_best_splits_equal_trying_all():
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), rng.randint(0, 2), rng.uniform(-1, 1), rng.uniform(0.1, 1)) for _ in range(60)]
    sums = [(1, f, v, sum(r[2] for r in rows if r[f] == v), sum(r[3] for r in rows if r[f] == v), sum(r[f] == v for r in rows)) for f in (0, 1) for v in {r[f] for r in rows}]
    gain = lambda part: sum(r[2] for r in part) ** 2 / (sum(r[3] for r in part) + P.SMOOTH)
    tried = {(f, v): gain([r for r in rows if r[f] <= v]) + gain([r for r in rows if r[f] > v]) - gain(rows) for f in (0, 1) for v in range(3 - f)}
    best = P.best_splits(sums, 1)[1]
    assert best[1:3] == max(tried, key=tried.get) and best[0] == pytest.approx(max(tried.values()))


def test_resolved_equals_islands(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        spans, at = [], 0
        for _ in range(rng.randint(0, 4)):
            at += rng.randint(0, 9)
            spans.append((at, rng.randint(0, 3), at + 3))
            at += 3
        added = [(s, 4 + rng.randint(0, 4), s + rng.randint(1, 8)) for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 5)))]
        rows.append((i, sorted(set(spans + added))))
    df = spark.createDataFrame(rows, "id int, spans array<struct<start:int,kind:int,end:int>>")
    for r in df.select("id", P.resolved(F.col("spans")).alias("out")).collect():
        want, island = [], []
        for s in rows[r.id][1] + [(10 ** 6, 0, 10 ** 6 + 1)]:
            if island and s[0] >= max(x[2] for x in island):
                own = [x for x in island if x[1] < 4]
                want += own or [(island[0][0], island[0][1], max(x[2] for x in island))]
                island = []
            island.append(s)
        assert [tuple(x) for x in r.out] == want


def test_luhn_and_account(spark):
    texts = ["4111111111111111", "4111111111111112", "0", "18", "79927398713", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013001"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(P.luhn(F.col("t")), P._is_account(F.col("t"))).collect()]
    assert [a for a, _ in got[:5]] == [luhn(t) for t in texts[:5]] and [b for _, b in got[5:]] == [True, True, False]


def test_redact(spark):
    texts = ["😀 mail a@b.c, 4111 1111 1111 1111!", "nothing", None, "1.2.3.4", "1.2.3.4"]
    rows = P.redact(frame(spark, [(1, t) for t in texts])).collect()
    assert sorted(r.redacted for r in rows) == sorted(["😀 mail [email], [card]!", "nothing", "", "[ip]", "[ip]"])


def test_empty_table_and_null_ids(spark):
    assert P.pii_report(frame(spark, [])).count() == 0
    rows = P.pii_report(frame(spark, [(None, "a@b.c"), (None, "a@b.c"), (2, None)])).collect()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in rows) == [("2", 0, ""), ("None", 1, "email:0:5"), ("None", 1, "email:0:5")]
