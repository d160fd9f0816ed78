"""Leave-one-out nearest neighbour by cosine: exact, or by a multi-probe hash index with exact re-ranking."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.features import unit
from veilspark.session import broadcast_if_small, write_through

MIN_NORM = 1e-12  # fixed value
DIGITS = 9
# Slack of the distance bounds.  Similarities are equal after rounding if they differ by less than
# 1e-9; by d = sqrt(2 - 2 s) distances may then differ by up to sqrt(2e-9), about 4.5e-5.
SLACK = 5e-5


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))


def _best_in_block(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(id, other, sim): the best vector of a block for each query; equal ones go to the lower id."""
    if not len(q) or not len(b):
        return pd.DataFrame({"id": [], "other": [], "sim": []})
    b = b.sort_values("id")
    ids, vectors = b["id"].to_numpy(), _stack(b["u"]).T
    out = []
    for start in range(0, len(q), 1024):
        part = q.iloc[start : start + 1024]
        sims = np.round(_stack(part["u"]) @ vectors, DIGITS)
        sims[part["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        best = sims.argmax(axis=1)
        found = pd.DataFrame(
            {"id": part["id"].to_numpy(), "other": ids[best], "sim": sims[np.arange(len(part)), best]}
        )
        out.append(found[np.isfinite(found["sim"])])
    return pd.concat(out)


def _spread_search(queries: DataFrame, base: DataFrame, block_rows: int, query_rows: int) -> DataFrame:
    """(id, other, sim): per query and cell it is sent to, the best other vector there.

    Both sides have (id, u, cell).  How many blocks and batches a cell is cut into comes from a join
    with the counted cells, so no cell, however full, is one group, and nothing passes the driver.
    """
    # both sides may come from one frame: their columns are told apart by new names
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in ("id", "u", "cell")])
    queries, base = fresh(queries), fresh(base)
    parts = lambda df, rows, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    counts = parts(base, block_rows, "blocks").join(parts(queries, query_rows, "batches"), "cell")
    counts = broadcast_if_small(write_through(queries.sparkSession, counts, "cell_counts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    sent = queries.join(counts, "cell").select("id", "u", "cell", every("blocks").alias("block"), one("batches", "batch").alias("batch"))
    held = base.join(counts, "cell").select("id", "u", "cell", one("blocks", "block").alias("block"), every("batches").alias("batch"))
    keys = ["cell", "block", "batch"]
    return sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_best_in_block, "id long, other long, sim double")


QUERY = "id long, u array<double>, cells array<int>, bins array<int>, firsts array<int>"


def _bins(sizes: np.ndarray, block_rows: int) -> np.ndarray:
    """The bin of each cell, in order: neighbouring cells share one of about `block_rows` vectors."""
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return (before // block_rows).astype("int32")


def _by_bin(cells: list[np.ndarray], bins: np.ndarray) -> dict[str, list]:
    """A query's cells in order (as numbers in the list of cells), its bins, and where in its cells each bin starts."""
    found = [np.unique(bins[row], return_index=True) for row in cells]
    return {"cells": cells, "bins": [x for x, _ in found], "firsts": [x.astype("int32") for _, x in found]}


def _best_in_bin(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(id, other, sim): the best vector for each query among those of its cells in a bin's block."""
    out = [pd.DataFrame({"id": [], "other": [], "sim": []})]
    if len(q) and len(b):
        rows = np.repeat(np.arange(len(q)), q["cells"].map(len).to_numpy())
        wanted = np.concatenate(q["cells"].to_list())
        for cell, part in b.groupby("cell"):
            out.append(_best_in_block(q.iloc[rows[wanted == cell]], part))
    best = pd.concat(out[1:] or out)
    return best.sort_values(["sim", "other"], ascending=[False, True]).drop_duplicates("id")


def _bin_search(queries: DataFrame, base: DataFrame, bins: np.ndarray, cell_ids: np.ndarray, block_rows: int, query_rows: int) -> DataFrame:
    """(id, other, sim): per stored query (`QUERY`) and bin it has a cell in, the best other vector of its cells there.

    A vector is sent once per bin and not once per cell, and bins hold about `block_rows` vectors
    however many cells there are.  A bin with a very full cell is cut into blocks and batches.
    """
    spark = queries.sparkSession
    at = spark.createDataFrame(pd.DataFrame({"cell": cell_ids, "place": np.arange(len(cell_ids), dtype="int32"), "bin": bins}), "cell int, place int, bin int")
    base = base.join(F.broadcast(at), "cell").select(F.col("id").alias("id"), F.col("u").alias("u"), F.col("place").alias("cell"), "bin")
    parts = lambda df, rows, name: df.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes = parts(base, block_rows, "blocks").join(parts(queries.select(F.explode("bins").alias("bin")), query_rows, "batches"), "bin")
    sizes = F.broadcast(write_through(spark, sizes, "bin_sizes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    start, after = F.get("firsts", F.col("pos")), F.coalesce(F.get("firsts", F.col("pos") + 1), F.size("cells"))
    sent = queries.select("*", F.posexplode("bins").alias("pos", "bin")).select("id", "u", "bin", F.slice("cells", start + 1, after - start).alias("cells"))
    sent = sent.join(sizes, "bin").select("id", "u", "cells", "bin", every("blocks").alias("block"), one("batches", "batch").alias("batch"))
    held = base.join(sizes, "bin").select("id", "u", "cell", "bin", one("blocks", "block").alias("block"), every("batches").alias("batch"))
    keys = ["bin", "block", "batch"]
    return sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_best_in_bin, "id long, other long, sim double")


def _best_other(reps: DataFrame, pivots: int | None, block_rows: int, query_rows: int) -> DataFrame:
    """(id, other, sim): the best other vector of each distinct vector.

    Every vector belongs to the cell of its nearest pivot and is first searched there.  By the
    triangle inequality a cell whose vectors lie between `lo` and `hi` from its pivot can hold
    something within `u` of a query only if the query lies between `lo - u` and `hi + u` from
    that pivot, where `u` is the distance to the best vector found so far (or to the nearest
    other pivot).  So a query travels on only to the cells that may hold a better one, and nothing is
    left out.  On clustered vectors that is a small share of the cells; where all
    distances are alike, as for noise in many dimensions, no bound prunes and the job is
    quadratic.
    """
    n = reps.count()
    wanted = pivots or max(1, math.ceil(math.sqrt(n)))
    chosen = (
        reps.select("id", "u").orderBy(F.md5(F.col("id").cast("string")), "id").limit(wanted).collect()
    )
    if not chosen:
        return reps.select("id", F.col("id").alias("other"), F.lit(0.0).alias("sim")).limit(0)
    spark = reps.sparkSession
    pivot_ids = np.array([r.id for r in chosen])
    pivot_vectors = np.array([r.u for r in chosen], dtype=np.float64)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(_stack(pdf["u"]), pivot_vectors)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), d=d[np.arange(len(d)), cell])

    cells = write_through(spark, reps.select("id", "u").mapInPandas(assign, "id long, u array<double>, cell int, d double"), "cells")
    # at most one row per pivot
    stats = cells.groupBy("cell").agg(
        F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")
    ).orderBy("cell").collect()
    cell_ids = np.array([r.cell for r in stats], dtype="int32")
    bins = _bins(np.array([r.n for r in stats]), block_rows)
    lo, hi = np.array([r.lo for r in stats]), np.array([r.hi for r in stats])
    best = F.max(F.struct("sim", (-F.col("other")).alias("neg"))).alias("_b")
    near = write_through(
        spark, _spread_search(cells.select("id", "u", "cell"), cells, block_rows, query_rows).groupBy("id").agg(best), "near")

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            d = _distances(_stack(pdf["u"]), pivot_vectors)
            to_others = np.where(pdf["id"].to_numpy()[:, None] == pivot_ids[None, :], np.inf, d).min(axis=1)
            so_far = np.sqrt(np.maximum(2.0 - 2.0 * pdf["sim"].fillna(-1.0).to_numpy(), 0.0))
            bound = np.minimum(to_others, so_far)[:, None] + SLACK
            away = d[:, cell_ids]
            open_cells = (away >= lo - bound) & (away <= hi + bound) & (cell_ids[None, :] != pdf["cell"].to_numpy()[:, None])
            yield pd.DataFrame({"id": pdf["id"], "u": pdf["u"], **_by_bin([np.flatnonzero(row).astype("int32") for row in open_cells], bins)})

    known = cells.select("id", "u", "cell").join(near.select("id", "_b.sim"), "id", "left")
    # stored with one vector per query, however many cells it goes to
    queries = write_through(spark, known.mapInPandas(reach, QUERY), "queries")
    far = _bin_search(queries, cells, bins, cell_ids, block_rows, query_rows).groupBy("id").agg(best)
    both = near.unionByName(far).groupBy("id").agg(F.max("_b").alias("_b"))
    return both.select("id", (-F.col("_b.neg")).alias("other"), F.col("_b.sim").alias("sim"))


#: The index: vectors that a cell holds on average, cells at most, and rows whose true neighbours set the probes.
CELL_ROWS, MAX_CELLS, CALIBRATION_ROWS = 512, 16384, 512


def _directions(cells: int, size: int, seed: int) -> np.ndarray:
    """The hash: a vector's cell is the direction it leans to most.  Made anew from the seed in every task."""
    r = np.random.default_rng(seed).standard_normal((cells, size))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def _lsh_best(reps: DataFrame, recall: float, cell_rows: int, seed: int, block_rows: int, query_rows: int) -> DataFrame:
    """(id, other, sim): the best vector found in the cells that a vector leans to most.

    Every vector is indexed in one cell.  A query probes its nearest cells in order.  How many is measured:
    the true neighbours of `CALIBRATION_ROWS` vectors, picked by hash, are found among all vectors, and probes are
    taken up to the rank by which a share `recall` of them has been met.  Found vectors are compared by their
    exact similarity.  On clustered vectors a few probes do; on noise in many dimensions most cells are probed.
    """
    spark = reps.sparkSession
    shape = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("u")).alias("d")).first()
    if shape.n < 2:
        return reps.select("id", F.col("id").alias("other"), F.lit(0.0).alias("sim")).limit(0)
    cells, size = min(MAX_CELLS, max(1, math.ceil(shape.n / cell_rows))), shape.d

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = _directions(cells, size, seed).T
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(cell=(_stack(pdf["u"]) @ planes).argmax(axis=1).astype("int32"))

    index = write_through(spark, reps.select("id", "u").mapInPandas(assign, "id long, u array<double>, cell int"), "index")
    sample = write_through(spark, index.orderBy(F.md5(F.col("id").cast("string")), "id").limit(CALIBRATION_ROWS), "calibration")
    whole = lambda df: df.select("id", "u", F.lit(0).alias("cell"))
    true = _spread_search(whole(sample), whole(index), block_rows, query_rows)
    true = true.groupBy("id").agg(F.max(F.struct("sim", (-F.col("other")).alias("neg"))).alias("b")).select("id", (-F.col("b.neg")).alias("other"))
    pairs = sample.select("id", "u").join(true, "id").join(index.select(F.col("id").alias("other"), F.col("cell").alias("wanted")), "other")

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = _directions(cells, size, seed).T
        for pdf in frames:
            if len(pdf):
                lean = _stack(pdf["u"]) @ planes
                own = lean[np.arange(len(lean)), pdf["wanted"].to_numpy()]
                yield pd.DataFrame({"rank": 1 + (lean > own[:, None]).sum(axis=1)})

    probes = pairs.select("u", "wanted").mapInPandas(rank, "rank long").agg(F.percentile("rank", recall).alias("p")).first().p
    probes = min(cells, math.ceil(probes or 1))

    # at most `MAX_CELLS` rows; a cell without vectors has no place
    sizes = index.groupBy("cell").count().orderBy("cell").collect()
    cell_ids = np.array([r.cell for r in sizes], dtype="int32")
    bins, place = _bins(np.array([r["count"] for r in sizes]), block_rows), np.full(cells, -1)
    place[cell_ids] = np.arange(len(cell_ids))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = _directions(cells, size, seed).T
        for pdf in frames:
            if len(pdf):
                nearest = np.argpartition(-(_stack(pdf["u"]) @ planes), probes - 1, axis=1)[:, :probes]
                held = [np.sort(row[row >= 0]).astype("int32") for row in place[nearest]]
                yield pd.DataFrame({"id": pdf["id"], "u": pdf["u"], **_by_bin(held, bins)})

    queries = write_through(spark, index.select("id", "u").mapInPandas(probe, QUERY), "probes")
    best = _bin_search(queries, index, bins, cell_ids, block_rows, query_rows).groupBy("id").agg(F.max(F.struct("sim", (-F.col("other")).alias("neg"))).alias("_b"))
    return best.select("id", (-F.col("_b.neg")).alias("other"), F.col("_b.sim").alias("sim"))


def knn_loo(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    pivots: int | None = None,
    block_rows: int = 8192,
    query_rows: int = 16384,
    recall: float | None = None,
    cell_rows: int = CELL_ROWS,
    seed: int = 42,
) -> DataFrame:
    """(key, expected, neighbor, predicted, similarity): the label of the nearest other vector.

    Exact by default.  With `recall` a hash index looks for the neighbour in as many cells as are needed to
    meet that share of true neighbours (see `_lsh_best`); a vector for which nothing is found there has no neighbour.

    Cosine in double, rounded to nine digits; equal similarity goes to the lower
    key.  Equal vectors are searched once: their members point at each other
    without being compared, so a vector with very many copies costs nothing extra.
    """
    units = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), unit(F.col(vector), MIN_NORM).alias("u")
    )
    stored = write_through(vectors.sparkSession, units, "units")
    # A rank limit of two is applied in every task before the shuffle.
    two = (
        stored.withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy("id")))
        .where("_r <= 2")
        .groupBy("u")
        .agg(F.min("id").alias("id"), F.max("id").alias("second"))
    )
    reps = write_through(
        vectors.sparkSession,
        two.select(
            "id",
            F.when(F.col("second") != F.col("id"), F.col("second")).alias("second"),
            F.round(F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x * x), DIGITS).alias("self_sim"),
            "u",
        ),
        "reps",
    )
    if recall is None:
        others = _best_other(reps, pivots, block_rows, query_rows)
    else:
        others = _lsh_best(reps, recall, cell_rows, seed, block_rows, query_rows)
    known = reps.select("u", F.col("id").alias("rep"), "second", "self_sim").join(
        others.withColumnRenamed("id", "rep"), "rep", "left"
    )
    # Equal vectors meet their group again through the vector itself.
    members = stored.select("id", "label", "u").join(known, "u")
    twin = F.when(F.col("second").isNotNull(), F.when(F.col("id") == F.col("rep"), F.col("second")).otherwise(F.col("rep")))
    by_twin = F.when(twin.isNotNull(), F.struct(F.col("self_sim").alias("s"), (-twin).alias("neg")))
    by_other = F.when(F.col("other").isNotNull(), F.struct(F.col("sim").alias("s"), (-F.col("other")).alias("neg")))
    best = members.select(
        "id", "label", F.array_max(F.array(by_twin, by_other)).alias("_b")
    ).select("id", "label", (-F.col("_b.neg")).alias("neighbor"), F.col("_b.s").alias("similarity"))
    labels = stored.select(F.col("id").alias("neighbor"), F.col("label").alias("predicted"))
    return best.join(labels, "neighbor", "left").select(
        F.col("id").alias(key), F.col("label").alias("expected"), "neighbor", "predicted", "similarity"
    )
