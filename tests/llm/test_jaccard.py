import random

import pytest
from pyspark.sql import functions as F

from veilspark.llm import jaccard as J
from veilspark.llm.components import components


def grams(t, n=5):
    w = (t or "").split(" ") if (t or "").strip() else []
    w = [x for y in w for x in y.split()]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    """Classes, links and groups by comparing all pairs."""
    key = [tuple((t or "").split()) or ("", k) for k, (_, t) in enumerate(rows)]
    cls = {}
    for (i, _), k in zip(rows, key):
        cls.setdefault(k, []).append(i)
    names = list(cls)
    sets = [grams(" ".join(k)) if k[0] != "" else set() for k in names]
    links = {k: set() for k in range(len(names))}
    for a in range(len(names)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
                links[a].add(b)
                links[b].add(a)
    group, out = {}, {}
    for a in range(len(names)):
        if a not in group:
            stack, seen = [a], {a}
            while stack:
                for y in links[stack.pop()] - seen:
                    seen.add(y)
                    stack.append(y)
            for x in seen:
                group[x] = seen
    for a, k in enumerate(names):
        members = [i for x in group[a] for i in cls[names[x]] if i is not None]
        real = [i for i in cls[k] if i is not None]
        out[k] = (min(real, default=None), len(cls[k]), len(links[a]), min(members, default=None),
                  sum(len(cls[names[x]]) for x in group[a]))
    return [(i, *out[k]) for (i, _), k in zip(rows, key)]


def corpus(seed=1, originals=12, copies=9):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(originals):
        base = [r.choice(vocab) for _ in range(r.choice([3, 30, 60, 200]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, "   "), (None, rows[5][1]), (None, "one two"), (i + 3, "one  two"), rows[7], rows[7]]


@pytest.mark.parametrize("block", [512, 3])
def test_equals_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, row string")
    got = J.near_copies(docs, block=block).select("doc_id", "class_id", "n_copies", "n_links", "group_id", "group_size")
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute(rows), key=order)


def test_recall_and_links_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = J.near_copies(docs).select("doc_id", "class_id", "n_copies", "n_links", "group_id", "group_size")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_keep_one_per_group(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, gone string")
    left = J.keep_one(docs)
    assert left.columns == docs.columns
    groups = {}
    for (i, t), g in zip(rows, brute(rows)):
        groups.setdefault((g[4], g[5]) if t and t.strip() and g[4] is not None else (i, t), set()).add((i, t))
    assert left.count() == len(groups)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_copies(docs).count() == 0 and J.keep_one(docs).count() == 0


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.9):
        b, r = J.choose_bands(t, 0.99, 400)
        assert 1 - (1 - t**r) ** b >= 0.99


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(90)]
    parent = {x: x for e in edges for x in e}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: find(x) for x in parent if x not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
