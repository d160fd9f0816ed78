"""Whitening against numpy over all vectors, and the split of matrices against LAPACK."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import whitening as W

SF = "/root/testdata/sf0.01"


def matrices():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    low = rng.standard_normal((10, 40))
    return {
        "one": np.array([[3.0]]), "zero": np.zeros((7, 7)), "identity": 2 * np.eye(9), "diagonal": np.diag(np.arange(12.0)),
        "random": np.cov(rng.standard_normal((50, 20)).T), "low rank": np.cov(low.T, bias=True),
        "equal and near": q @ np.diag([1.0] * 10 + [2.0] * 10 + [2 + 1e-9] * 10) @ q.T, "falling": q @ np.diag(0.5 ** np.arange(30)) @ q.T}


@pytest.mark.parametrize("name", matrices())
def test_components_of(name):
    v = matrices()[name]
    values, vectors = W.components_of(v)
    size = max(np.abs(v).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * len(v) * size, rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(v))).max() < 1e-13
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-13 * len(v) * size


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((15, 15))
    u, _, w = np.linalg.svd(a)
    assert np.allclose(W.polar(a), u @ w, atol=1e-12)


def brute(vectors):
    """n, and per usable vector its deviation and whitened components, from all of them at once."""
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), y @ u / np.sqrt(e), e / np.trace(v)


def test_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [r for r in table.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    n, deviation, white, share = brute([r.embedding for r in rows])
    place = {r.vec_id: i for i, r in enumerate(rows)}
    got = W.components_table(table).collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = np.sign(sum(white[place[r.vec_id], r.component - 1] * r.whitened * np.eye(32)[r.component - 1] for r in got))
    for r in got:
        i, k = place[r.vec_id], r.component - 1
        assert r.deviation == deviation[i] and abs(r.explained / share[k] - 1) < 1e-9
        assert abs(r.whitened - signs[k] * white[i, k]) < 1e-6 * (1 + abs(white[i, k]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, deviation string")


def test_unusable_rows_and_clashing_names(spark):
    good = [(i, [float(i % 7), float(i * i % 11), 1.5], "x", "y") for i in range(40)]
    bad = [(90, None, "x", "y"), (91, [1.0, None, 2.0], "x", "y"), (92, [1.0, float("nan"), 2.0], None, "y"), (93, [float("inf"), 0.0, 1.0], "x", "y"),
           (94, [], "x", "y"), (95, [1.0, 2.0], "x", "y"), (96, [1e300, 0.0, 0.0], "x", "y")]
    df = frame(spark, good + good[:3] + bad)
    got = W.components_table(df).collect()
    n, deviation, white, share = brute([v for _, v, *_ in good + good[:3]])
    assert {r.vec_id for r in got} == set(range(40)) and len(got) == 43 * 3 and {r.n for r in got} == {43}
    # the third entry never varies: no variance, null, and no part in the error
    assert all((r.whitened is None) == (r.component == 3) for r in got) and got[0].identity_error < 1e-9
    assert {(r.vec_id, r.deviation) for r in got} == {(v[0], int(d)) for v, d in zip(good + good[:3], deviation)}
    kept = W.whiten(df, W.fit(df))
    assert kept.columns == ["vec_id", "embedding", "component", "deviation", "whitened"]


def test_empty_single_and_large(spark):
    assert W.components_table(frame(spark, [])).count() == 0
    assert W.components_table(frame(spark, [(1, None, "", "")])).count() == 0
    one = W.components_table(frame(spark, [(1, [2.0, 3.0], "", "")])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, 0.0, 0.0) for k in (1, 2)]
    far = [(i, [float(2 ** 40 * i), float(i % 3)], "", "") for i in range(20)]
    got = {r.vec_id: r.deviation for r in W.components_table(frame(spark, far)).collect()}
    assert all(d is None for d in got.values())  # no long holds them


def test_partitions_do_not_matter(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").limit(300)
    one = W.fit(table.coalesce(1))
    many = W.fit(table.repartition(23).withColumn("extra", F.lit(1)))
    assert one.sums == many.sums and np.allclose(one.values, many.values, rtol=1e-10)
