import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.llm import decontaminate as D


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(doc, items):
    w = words(doc)
    hit, found = set(), set()
    for item, text in items:
        v = words(text)
        if not v:
            continue
        size = min(10, len(v))
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def corpus():
    r = random.Random(3)
    vocab = ["Größe", "a", "b", "C1", "d", "日本", "x9", "Ünder", "to", "be"]
    say = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, say(r.randint(8, 30))) for i in range(12)] + [(50, "only three words"), (51, ""), (52, None), (None, say(14)), (3, say(12))]
    docs = []
    for i in range(60):
        parts = [say(r.randint(0, 30))]
        if i % 2:
            v = words(r.choice(items)[1])
            k = r.randint(0, max(0, len(v) - 10))
            parts += [" ".join(v[k : k + r.randint(8, 20)]).upper().lower(), say(8)]
        docs.append((i, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "Only THREE words"), (103, "three words"), (None, items[0][1])], items


@pytest.mark.parametrize("slice_chars", [10**6, 200])
def test_equals_brute_force(spark, slice_chars):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1, "f") for i, t in docs], "doc_id long, text string, n_words int, found string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(d, b, slice_chars=slice_chars).collect()}
    assert got == {i: brute(t, items) for i, t in docs}


def test_clashing_names_in_slices(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1, "f") for i, t in docs], "doc_id long, text string, __key int, row_key string").withColumn("found", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({(r.doc_id, r.text) for r in D.decontaminate(d, b, slice_chars=n).collect()} for n in (10**6, 40))
    assert one == many and D.decontaminate(d, b, slice_chars=40).columns == d.columns


def test_spans_and_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    long = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"{long} One, two three four five six seven eight nine ten! {long}", 7, "x"), (2, item, 7, "x"), (3, long, 7, "x"), (4, None, 7, "x"), (3, long, 7, "x")],
                                 "doc_id long, text string, n_chars int, found string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = D.decontaminate(docs, bench)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, f"{long} ! {long}"), (3, long), (3, long), (4, None)], key=str)
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench, remove="documents").collect()) == [3, 3, 4]
    assert D.decontaminate(docs.limit(0), bench).count() == 0 and D.decontaminate(docs, bench.limit(0)).count() == 5
    with pytest.raises(ValueError):
        D.decontaminate(docs, bench, remove="all")
