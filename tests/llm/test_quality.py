import zlib

import numpy as np
import pytest

from veilspark.llm import quality as Q

SF = "/root/testdata/sf0.01"


def walk(model, x):
    """One row down one tree at a time."""
    depth = int(np.log2(model.leaf.shape[1])) if len(model.leaf) else 0
    out = []
    for row in x:
        m = model.start
        for f, t, v in zip(model.feature, model.threshold, model.leaf):
            k = 0
            for _ in range(depth):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            m += v[k - len(f)]
        out.append(1 / (1 + np.exp(-m)))
    return np.array(out)


def test_flat_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = Q.train(x, y, trees=30, depth=3)
    assert np.allclose(model.score(x), walk(model, x))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97


def test_statistics_are_finite_for_any_text():
    for t in ("", " \n ", "a", "|", "é" * 5, "x " * 100_000, "\n\n", "!!", "日本 語"):
        s = Q.statistics(t)
        assert len(s) == len(Q.FEATURES) and np.isfinite(s).all()


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.doc_id, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    right = [got[i].predicted == q for i, q in held]
    assert len(held) > 50 and np.mean(right) > 0.95
    flipped = labels.selectExpr("doc_id", "case when crc32(string(doc_id)) % 3 = 1 then 1 - quality else quality end quality")
    again = Q.fit(docs, flipped)
    assert np.array_equal(model.leaf, again.leaf) and np.array_equal(model.threshold, again.threshold)


def test_bounded_sample(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x, y = Q.training_rows(docs, labels, id_col="doc_id", text_col="text", label_col="quality", max_rows=20)
    assert x.shape == (20, len(Q.FEATURES)) and len(y) == 20


def test_nulls_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, None, 1, 2), (1, "", 1, 2), (2, "some words here", 1, 2), (2, "some words here", 1, 2)], "doc_id long, text string, score int, label int")
    labels = spark.createDataFrame([(None, 1), (2, None), (2, 7), (99, 1)], "doc_id long, quality int")
    out = Q.score(docs, Q.fit(docs, labels)).collect()
    assert len(out) == 4 and all(r.score == pytest.approx(0.5) for r in out)
    one = Q.score(docs, Q.fit(docs, spark.createDataFrame([(2, 1), (2, 1)], "doc_id long, quality int"))).collect()
    assert len(one) == 4 and len({r.score for r in one if r.doc_id == 2}) == 1
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), labels.limit(0))).count() == 0
