"""The hash index against the exact search."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators.neighbors import knn_loo


def compared(spark, vectors, **options):
    """(share of neighbours as near as the exact one, rows)."""
    exact = {r.vec_id: r for r in knn_loo(vectors).collect()}
    found = {r.vec_id: r for r in knn_loo(vectors, **options).collect()}
    assert exact.keys() == found.keys()
    for i, r in found.items():
        if r.neighbor is not None:
            assert r.similarity <= exact[i].similarity + 1e-9 and r.expected == exact[i].expected and r.neighbor != i
    return sum(r.neighbor is not None and r.similarity >= exact[i].similarity - 1e-9 for i, r in found.items()) / max(1, len(exact)), len(exact)


def frame(spark, x, labels=None):
    rows = [(i, [float(c) for c in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    share, n = compared(spark, vectors, recall=0.95, cell_rows=40)
    print(sf, n, share)
    assert share >= 0.9


def test_recall_on_clusters_with_few_probes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 3000)] + 0.05 * rng.standard_normal((3000, 32))
    from veilspark.operators import neighbors

    probed = []
    real = neighbors._spread_search
    monkeypatch.setattr(neighbors, "_spread_search", lambda q, b, *a: probed.append((q.count(), b.count())) or real(q, b, *a))
    share, n = compared(spark, frame(spark, x), recall=0.95, cell_rows=50)
    assert share >= 0.9 and n == 3000
    # the last search is that of all queries: a few cells of 60 each
    assert probed[-1][1] == n and probed[-1][0] <= 12 * n


def test_copies_small_tables_and_no_collect_of_vectors(spark):
    x = np.tile(np.eye(3), (40, 1))
    share, _ = compared(spark, frame(spark, x), recall=0.9, cell_rows=1)
    assert share == 1
    assert knn_loo(frame(spark, x[:0]), recall=0.9).count() == 0
    one = knn_loo(frame(spark, x[:1]), recall=0.9).collect()
    assert len(one) == 1 and one[0].neighbor is None
    two = {r.vec_id: r.neighbor for r in knn_loo(frame(spark, x[:2]), recall=1.0, cell_rows=1).collect()}
    assert two == {0: 1, 1: 0}


def test_index_does_not_depend_on_partitions(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    a = knn_loo(vectors.coalesce(1), recall=0.8, cell_rows=30)
    b = knn_loo(vectors.repartition(7).withColumn("cell", F.lit(1)), recall=0.8, cell_rows=30)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_a_vector_is_stored_and_sent_once_per_bin_not_per_cell(spark, monkeypatch):
    """Noise goes to every cell: still one stored row per query, and the exact neighbours."""
    from veilspark.operators import neighbors

    x = np.random.default_rng(7).standard_normal((400, 16))
    stored = {}
    real = neighbors.write_through

    def noted(session, df, name):
        out = real(session, df, name)
        stored[name] = out
        return out

    monkeypatch.setattr(neighbors, "write_through", noted)
    got = {r.vec_id: (r.neighbor, r.similarity) for r in knn_loo(frame(spark, x), pivots=40, block_rows=100).collect()}
    queries = stored["queries"]
    assert queries.count() == 400 and queries.agg(F.max(F.size("cells"))).first()[0] > 10
    assert queries.agg(F.max(F.size("bins"))).first()[0] <= 5
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    np.fill_diagonal(sims, -np.inf)
    assert got == {i: (int(row.argmax()), pytest.approx(float(row.max()))) for i, row in enumerate(sims)}
