import math
import random
import re

from veilspark.functions.patterns import DEFAULT_RULES
from veilspark.operators import layout as L


def runs_frame(spark):
    rng = random.Random(5)
    rows = []
    for doc in range(6):
        for run in range(rng.randint(1, 40)):
            words = [rng.choice(["a", "word", "x@y.com", "10.0.0.1", "längere", ""]) for _ in range(rng.randint(0, 9))]
            text = rng.choice([" ", "  ", "\t"]).join(words)
            rows.append((doc, run // 10, run, text, rng.uniform(0, 90), rng.choice([0, 12, 24]) + rng.uniform(0, 3), 4.0 * len(text) + 1, rng.choice([None, 0.0, 9.5])))
    schema = "doc_id long, page int, run int, text string, x double, y double, width double, height double"
    return rows, spark.createDataFrame(rows, schema).repartition(3)


def tokens_by_hand(rows):
    out, ids = [], {}
    for doc, page, _, text, x, y, width, height in sorted(rows, key=lambda r: r[:3]):
        words = [w for w in re.split(r"\s+", text) if w]
        if not words:
            continue
        char = width / len(text)
        for w in words:
            n = ids.get(doc, 0)
            ids[doc] = n + 1
            out.append((doc, n, page, w, x, y, char * len(w), height or 12.0))
            x += char * (len(w) + 1)
    return out


def test_tokens(spark):
    rows, df = runs_frame(spark)
    got = sorted(tuple(r) for r in L.runs_to_tokens(df).collect())
    want = sorted(tokens_by_hand(rows))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert all(abs(a - b) < 1e-6 for a, b in zip(g[4:], w[4:], strict=True))


def test_flags_and_rectangles(spark):
    rows, df = runs_frame(spark)
    tokens = L.runs_to_tokens(df)
    known = spark.createDataFrame([(0, "word"), (0, "word"), (1, "nothing")], "doc_id long, text string")
    picked = spark.createDataFrame([(2, 0), (2, 0), (3, 1)], "doc_id long, token_id long")
    flagged = L.flag_tokens(tokens, known, picked)
    want = [
        t for t in tokens_by_hand(rows)
        if t[3] in ("x@y.com", "10.0.0.1") or (t[0] == 0 and t[3] == "word") or (t[0], t[1]) in ((2, 0), (3, 1))
    ]
    assert sorted((r.doc_id, r.token_id) for r in flagged.collect()) == sorted(t[:2] for t in want)

    lines = {}
    for doc, token, page, _, x, y, w, h in want:
        lines.setdefault((doc, page, math.floor(y / 2 + 0.5) * 2), []).append((x, token, y, w, h))
    rects = []
    for (doc, page, _), group in lines.items():
        run = None
        for x, _, y, w, h in sorted(group):
            if run and x - run[1] <= 10:
                run[1], run[3] = max(run[1], x + w), max(run[3], h)
            else:
                run = [x, x + w, y, h]
                rects.append((doc, page, run))
    expected = sorted((d, p, r[0] - 1, r[2] - 1, r[1] - r[0] + 2, r[3] + 2) for d, p, r in rects)
    got = sorted((r.doc_id, r.page, r.x, r.y, r.w, r.h) for r in L.merge_rects(flagged).collect())
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert all(abs(a - b) < 1e-6 for a, b in zip(g, e, strict=True))


def test_a_value_over_several_words_flags_them_all(spark):
    rows = [(1, 0, 0, " call  (212) 555-0147 now", 0.0, 0.0, 100.0, None), (1, 0, 1, "plain", 0.0, 20.0, 50.0, None)]
    runs = spark.createDataFrame(rows, "doc_id long, page int, run int, text string, x double, y double, width double, height double")
    flagged = L.flag_tokens(L.runs_to_tokens(runs, DEFAULT_RULES))
    assert sorted((r.text, r.category) for r in flagged.collect()) == [("(212)", "PHONE"), ("555-0147", "PHONE")]
    assert [tuple(r) for r in L.layout_vault(flagged).collect()] == [(1, "PHONE", "212) 555-0147", "__PHONE_1__")]


def test_line_key_rounds_halves_up(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.9,), (1.0,), (2.9,), (3.0,), (-1.0,)], "y double")
    assert [r[0] for r in df.select(L.line_key(F.col("y"))).collect()] == [0, 2, 2, 4, 0]


def test_words_of_any_white_space_are_made_behind_one_shuffle(spark):
    """Words, values and ids are those of a plain split, and the patterns run once and behind the only shuffle."""
    texts = ["\u3000mail\u2003x@y.com \u00a0 end", "  a  10.0.0.1\tb ", "é x@y.com", "\u3000"]
    rows = [(1, k // 2, k, t, 0.0, 0.0, float(len(t)), None) for k, t in enumerate(texts)] + [(None, 0, 0, "lost", 0.0, 0.0, 4.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, run int, text string, x double, y double, width double, height double")
    tokens = L.runs_to_tokens(df.repartition(2), DEFAULT_RULES)
    got = sorted(tuple(r) for r in tokens.select("token_id", "page", "text", "category", "value", "x").collect())
    mail = ("EMAIL", "x@y.com")
    assert got == [
        (0, 0, "mail", None, None, 0.0), (1, 0, "x@y.com", *mail, 5.0), (2, 0, "end", None, None, 13.0),
        (3, 0, "a", None, None, 0.0), (4, 0, "10.0.0.1", "IP_ADDRESS", "10.0.0.1", 2.0), (5, 0, "b", None, None, 11.0),
        (6, 1, "é", None, None, 0.0), (7, 1, "x@y.com", *mail, 2.0)]
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and plan.count("Join") == 0
    # the three uses of one run of a pattern: marked, and twice for a text that holds a mark itself
    assert plan.count("AKIA[A-Z0-9]{16}") == 3
