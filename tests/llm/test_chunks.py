import random

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import chunks as C


def slow_ends(text):
    """The rolling hash one character at a time."""
    table = {c: int(C.gear(np.array([ord(c)]))[0]) for c in set(text)}
    ends, last, h = [], 0, 0
    for i, c in enumerate(text, 1):
        h = ((h << 1) + table[c]) & 0xFFFFFFFF
        if i - last >= C.MIN_CHUNK and h >> (32 - C.CUT_BITS) == 0 or i - last == C.MAX_CHUNK:
            ends.append(i)
            last = i
    return ends + [len(text)] * (last < len(text))


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiéß日") for _ in range(r.randint(1, 9))) for _ in range(n))


def test_chunks_equal_one_character_at_a_time():
    texts = ["", "a", "x" * 1000, words(300, 1), "", words(5, 2), "ab" * 400, words(2000, 3)]
    for t, got in zip(texts, C.chunk_ends(texts)):
        assert got == slow_ends(t)


def test_an_insertion_moves_few_chunks():
    t = words(500, 4)
    for at in (0, 700, 1500):
        u = t[:at] + "inserted" + t[at:]
        a, b = C.chunk_ends([t, u])
        cut = lambda x, e: {x[i:j] for i, j in zip([0, *e], e)}
        assert len(cut(t, a) - cut(u, b)) <= 6


def brute(rows, min_chars):
    holders = {}
    for key, t in rows:
        e = slow_ends(t)
        for a, b in zip([0, *e], e):
            holders.setdefault(t[a:b], set()).add(key)
    out = {}
    for key, t in rows:
        e, seen, gone, shared = slow_ends(t), set(), [], []
        for a, b in zip([0, *e], e):
            c = t[a:b]
            if c in seen or len(holders[c]) > 1:
                shared.append((a, b))
                if c in seen or min(holders[c]) != key:
                    gone.append((a, b))
            seen.add(c)
        out[key] = (C.runs(gone, min_chars), C.runs(shared, min_chars))
    return out


def test_equals_brute_force_and_finds_passages(spark):
    r = random.Random(5)
    passages = [words(60, 100 + k) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [words(r.randint(5, 80), 1000 + i)]
        if i % 2:
            parts += [r.choice(passages), words(r.randint(5, 40), 2000 + i)]
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, chunk_row string")
    keys = {x.doc_id: x.k for x in docs.select("doc_id", C.row_key("doc_id", "text").alias("k")).collect()}
    want = brute([(keys[i], t) for i, t in rows], C.MIN_CHARS)
    got = {x.doc_id: x for x in C.repeat_report(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        removed, shared = want[keys[i]]
        assert [tuple(s) for s in got[i].removed_spans] == removed and [tuple(s) for s in got[i].repeated_spans] == shared
    held = {i for i, t in rows if any(p in t and sum(p in u for _, u in rows) > 1 for p in passages)}
    assert {i for i in got if got[i].repeated} == held
    left = {x.doc_id: x.text for x in C.dedup_substrings(docs).collect()}
    for i, t in rows:
        for a, b in reversed(want[keys[i]][0]):
            t = t[:a] + t[b:]
        assert left[i] == t


def test_nulls_repeated_rows_and_long_texts(spark):
    long = words(30_000, 9)
    rows = [(1, None, 5), (2, "", 5), (None, words(90, 1), 5), (3, words(90, 1), 5), (3, words(90, 1), 5), (4, long, 5), (5, "z" + long, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    report = C.repeat_report(docs)
    assert report.count() == len(rows)
    by = {}
    for x in report.collect():
        by.setdefault(x.doc_id, []).append(x)
    assert not by[1][0].repeated and not by[2][0].repeated and by[None][0].repeated and len(by[3]) == 2
    assert by[4][0].n_removed + by[5][0].n_removed > len(long) - 400
    out = C.dedup_substrings(docs)
    assert out.columns == docs.columns and out.where("n_chars <> length(coalesce(text, ''))").count() == 0
    assert out.where(F.col("text").isNull()).count() == 1
    assert C.repeat_report(docs.limit(0)).count() == 0


def test_finds_fifty_short_words():
    r = random.Random(11)
    some = lambda n, low, high: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(low, high))) for _ in range(n))
    for low, high, share in ((2, 4, 0.95), (2, 5, 0.97), (1, 7, 0.98), (2, 8, 0.99)):
        found = 0
        for _ in range(300):
            p = some(50, low, high)
            a, b = [f"{some(60, 1, 9)} {p} {some(60, 1, 9)}" for _ in range(2)]
            x, y = C.chunk_ends([a, b])
            held = {b[i:j] for i, j in zip([0, *y], y)}
            found += bool(C.runs([(i, j) for i, j in zip([0, *x], x) if a[i:j] in held], C.MIN_CHARS))
        assert found / 300 >= share, (low, high, found / 300)
