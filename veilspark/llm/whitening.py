"""Whitening of embeddings: components by spectral divide and conquer, applied from a broadcast matrix.

Vectors are fixed-point: an entry c becomes the whole number x = floor(SCALE * c) + SHIFT.  Three
passes over the column, each of which leaves a task as one small table of cells, summed in Spark:

1. number of vectors n and exact sums S per dimension;
2. the covariance V of x, with S / n taken off every x before it is multiplied;
3. after whitening, the covariance of the whitened vectors, which is held against the identity.

In between the driver, which holds d x d numbers and nothing per vector, splits V into components.
The polar factor of V - s I, by QDWH iterations (Halley's, with weights from a lower bound of the
singular values, through QR while the bound is small and through Cholesky after that), is the matrix
sign of V - s I; (sign + I) / 2 projects on the span of all eigenvectors above s.  An orthonormal
basis of that span and of its complement turns V into two blocks, which are split in the same
way at their own shifts, until a block has one row or is a multiple of the identity.

Defined results: rows whose vector is null, or holds a null, a NaN or an infinite entry, are left out.
So are rows with an entry beyond +-2^46, whose x a double does not hold exactly, and
rows with another length than the most frequent one (of equally frequent ones the greatest).  Repeated rows each
count.  A component without variance (its eigenvalue is rounding) has `whitened` null and takes no part in
`identity_error`; with no component left that is 0.  A deviation that no long holds is null.  An empty
table, or one without usable vectors, gives no rows.  Other columns pass through `whiten`, whatever
their names.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import free_name, small_batches

SCALE, SHIFT = 64, 1_000_000
MAX_COMPONENTS = 32
#: Entries beyond this have no exact fixed-point form.
MAX_ENTRY = 2.0 ** 46
#: Rows of an Arrow batch: with 4,096 dimensions a batch of doubles has 128 MB.
BATCH = 4096
_EPS = np.finfo(float).eps


# --- spectral divide and conquer, on d x d matrices ---------------------------------------------


def polar(a: np.ndarray, max_steps: int = 60) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by QDWH iterations."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    # the Frobenius norm bounds the greatest singular value; the least one is bounded through R's inverse
    r = np.linalg.qr(x, mode="r")
    least = np.abs(np.diag(r)).min()
    low = 1 / (np.linalg.norm(np.linalg.inv(r)) if least > _EPS * _EPS else np.inf)
    low = min(max(low, _EPS * _EPS), 1.0)
    eye = np.eye(n)
    for _ in range(max_steps):
        d = np.cbrt(4 * (1 - low * low) / low ** 4)
        a_ = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))) / 2
        b_ = (a_ - 1) ** 2 / 4
        c_ = a_ + b_ - 1
        if c_ > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c_) * x, eye]))
            y = b_ / c_ * x + (a_ - b_ / c_) / np.sqrt(c_) * (q[:n] @ q[n:].T)
        else:
            w = np.linalg.cholesky(eye + c_ * (x.T @ x))
            y = b_ / c_ * x + (a_ - b_ / c_) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        low = min(low * (a_ + b_ * low * low) / (1 + c_ * low * low), 1.0)
        moved = np.linalg.norm(y - x)
        x = y
        if moved <= 1e-15 ** (1 / 3) * np.sqrt(n) and abs(1 - low) <= 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, shift: float, seed: int) -> np.ndarray | None:
    """An orthonormal basis whose first columns span the eigenvectors above the shift; None if that fails."""
    n = len(a)
    sign = polar(a - shift * np.eye(n))
    sign = (sign + sign.T) / 2
    projector = (sign + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n or np.linalg.norm(sign @ sign - np.eye(n)) > 1e-8 * n:
        return None
    q = np.random.default_rng(seed).standard_normal((n, k))
    for _ in range(3):
        q, _ = np.linalg.qr(projector @ q)
    basis, _ = np.linalg.qr(q, mode="complete")
    return basis, k


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Blocks still to be split wait on a stack, so deep splits need no deep recursion.
    """
    n = len(v)
    norm = np.linalg.norm(v)
    values, vectors = np.zeros(n), np.zeros((n, n))
    stack, at = [((v + v.T) / 2, np.eye(n))], 0
    while stack:
        a, basis = stack.pop()
        m = len(a)
        middle = np.trace(a) / m
        if m == 1 or np.linalg.norm(a - middle * np.eye(m)) <= m * _EPS * norm:
            values[at : at + m] = np.diag(a)
            vectors[:, at : at + m] = basis
            at += m
            continue
        # every shift between the least and the greatest eigenvalue splits; the median splits evenly
        diag = np.diag(a)
        spread = max(diag.max() - diag.min(), np.linalg.norm(a - np.diag(diag)) / m)
        shifts = [np.median(diag), middle, *(middle + spread * s for s in (0.01, -0.01, 0.1, -0.1, 0.03, -0.03, 0.3, -0.3))]
        found = next((s for i, t in enumerate(shifts) if (s := _split(a, float(t), i)) is not None and _apart(a, s, norm)), None)
        if found is None:
            raise ArithmeticError(f"no shift splits a block of {m} rows")
        q, k = found
        turned = q.T @ a @ q
        turned = (turned + turned.T) / 2
        stack.append((turned[k:, k:], basis @ q[:, k:]))
        stack.append((turned[:k, :k], basis @ q[:, :k]))
    order = np.argsort(-values, kind="stable")
    # Gram-Schmidt once more takes out the rounding that products of bases gather
    q, r = np.linalg.qr(vectors[:, order])
    return values[order], q * np.sign(np.diag(r))


def _apart(a: np.ndarray, split, norm: float) -> bool:
    q, k = split
    return np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) <= 100 * len(a) * _EPS * norm


# --- passes over the vectors ---------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What the fit leaves: d numbers and d x d numbers, whatever the number of vectors."""

    n: int
    size: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def count(self) -> int:
        return min(MAX_COMPONENTS, self.size)

    def matrix(self) -> np.ndarray:
        """d x components; a component without variance is a column of NaN."""
        e = self.values[: self.count]
        usable = e > self.size * 8 * _EPS * max(self.values[0], 0.0)
        return np.where(usable, self.vectors[:, : self.count] / np.sqrt(np.where(usable, e, 1.0)), np.nan)

    def explained(self) -> list[float]:
        return [float(x / self.trace) if self.trace > 0 else 0.0 for x in self.values[: self.count]]


def _fixed(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The usable vectors of a batch as (length, row numbers, x), one entry per length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    flat = column.values.cast(pa.float64())
    entries = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = np.isfinite(entries) & (np.abs(np.where(np.isfinite(entries), entries, 0)) <= MAX_ENTRY)
    bad_before = np.concatenate([[0], np.cumsum(~good)])
    usable = (bad_before[offsets[1:]] == bad_before[offsets[:-1]]) & np.asarray(column.is_valid()) & (lengths > 0)
    out = []
    for length in np.unique(lengths[usable]) if size is None else [size]:
        rows = np.flatnonzero(usable & (lengths == length))
        if len(rows):
            at = offsets[rows][:, None] + np.arange(length)
            out.append((int(length), rows, np.floor(SCALE * entries[at]).astype(np.int64) + SHIFT))
    return out


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, place, total): per length the sum of each place, and under place -1 the number of vectors."""
    totals: dict[int, list] = {}
    for batch in batches:
        for length, rows, x in _fixed(batch.column(0)):
            have = totals.setdefault(length, [0] * (length + 1))
            have[0] += len(rows)
            # a batch's sums stay below 2^63: 4,096 rows of at most 2^52
            for i, s in enumerate((x.sum(axis=0) if len(x) <= 1024 else x.astype(object).sum(axis=0)).tolist()):
                have[i + 1] += s
    for length, have in totals.items():
        yield pa.RecordBatch.from_pydict({
            "size": pa.array([length] * len(have), pa.int32()), "place": pa.array(range(-1, length), pa.int32()),
            "total": pa.array([str(h) for h in have], pa.string())})


def _moments(values: Iterator[np.ndarray], d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred products of all rows, merged batch by batch from each batch's own mean."""
    n, mean, products = 0, np.zeros(d), np.zeros((d, d))
    for y in values:
        k = len(y)
        m = y.mean(axis=0)
        y = y - m
        step = m - mean
        products += y.T @ y + np.outer(step, step) * (n * k / (n + k))
        mean += step * (k / (n + k))
        n += k
    return n, mean, products


def _cells(n: int, mean: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
    """The products about zero offset of the given centre, and sums, as cells that add up over tasks."""
    d = len(mean)
    i, j = np.triu_indices(d)
    about = products + n * np.outer(mean, mean)
    return pa.RecordBatch.from_pydict({
        "i": pa.array(np.concatenate([np.full(d, -1), i]).astype(np.int32)),
        "j": pa.array(np.concatenate([np.arange(d), j]).astype(np.int32)),
        "v": pa.array(np.concatenate([n * mean, about[i, j]]))})


def _covariance(vectors: DataFrame, values, d: int, n: int) -> np.ndarray:
    """Covariance of what `values` makes of each batch; the mean of that is near zero over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, products = _moments((y for b in batches for y in values(b)), d)
        if count:
            yield _cells(count, mean, products)

    # at most one row per cell and task; the cells of all tasks are summed before they reach the driver
    rows = vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out, mean = np.zeros((d, d)), np.zeros(d)
    for r in rows:
        if r.i < 0:
            mean[r.j] = r.v / n
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out - np.outer(mean, mean)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """x - S / n, and its exact numerator n x - S where that fits 64 bits (else None)."""
    low, high = int(x.min()), int(x.max())
    if max(abs(n * low), abs(n * high)) + max(abs(int(s)) for s in sums) < 2 ** 62:
        top = n * x - np.array(sums, dtype=np.int64)
        return top / n, top
    # whole parts first: S = n q + r, so x - S / n = (x - q) - r / n
    q = np.array([int(s) // n for s in sums], dtype=np.int64)
    r = np.array([int(s) % n for s in sums], dtype=object)
    return (x - q) - (r / n).astype(float), None


def fit(vectors: DataFrame, *, vec_col: str = "embedding") -> Whitening | None:
    """The components of all usable vectors; None if there are none."""
    spark = vectors.sparkSession
    small_batches(spark, BATCH)
    column = vectors.select(F.col(f"`{vec_col}`").alias("v"))
    cells = column.mapInArrow(_sums, "size int, place int, total string")
    cells = cells.groupBy("size", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    per_size = cells.groupBy("size").agg(
        F.max(F.when(F.col("place") < 0, F.col("total"))).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "total")))).alias("sums"))
    # vectors of one length are the rule: the row that is fetched holds one number per dimension
    best = per_size.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not best:
        return None
    n, d, sums = int(best[0].n), best[0]["size"], tuple(int(s.total) for s in best[0].sums)
    centred = lambda b: (_centred(x, n, sums)[0] for _, _, x in _fixed(b.column(0), d))
    v = _covariance(column, centred, d, n)
    values, basis = components_of(v)
    model = Whitening(n, d, sums, values, basis, float(np.trace(v)))
    usable = ~np.isnan(model.matrix()[0])
    if not usable.any():
        return model
    w = spark.sparkContext.broadcast(np.ascontiguousarray(model.matrix()[:, usable]))
    k = int(usable.sum())
    white = _covariance(column, lambda b: (y @ w.value for y in centred(b)), k, n)
    error = float(np.abs(white - np.eye(k)).max())
    return Whitening(n, d, sums, values, basis, model.trace, error)


def whiten(vectors: DataFrame, model: Whitening | None, *, vec_col: str = "embedding", out_col: str = "whitened",
           deviation_col: str = "deviation") -> DataFrame:
    """The usable rows with two more columns: the whitened vector (components in order) and the exact
    squared distance of n x from S.  Columns of those names in `vectors` are replaced."""
    spark = vectors.sparkSession
    small_batches(spark, BATCH)
    kept = [f for f in vectors.schema.fields if f.name.lower() not in (out_col.lower(), deviation_col.lower())]
    rows = vectors.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{vec_col}`").alias(free_name(vectors, "vector_in")))
    out = T.StructType([*kept, T.StructField(deviation_col, T.LongType()), T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    if model is None:
        return spark.createDataFrame([], out)
    w = spark.sparkContext.broadcast(model.matrix())
    n, d, sums = model.n, model.size, model.sums

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, picked, x in _fixed(batch.column(batch.num_columns - 1), d):
                y, top = _centred(x, n, sums)
                if top is not None and int(np.abs(top).max()) ** 2 * d < 2 ** 63:
                    deviation = pa.array((top * top).sum(axis=1))
                else:
                    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
                    deviation = pa.array([e if e < 2 ** 63 else None for e in exact], pa.int64())
                white = y @ w.value
                flat = pa.array(white.ravel(), from_pandas=True)  # NaN: no variance, null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]), flat)
                rest = batch.take(pa.array(picked)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*rest, deviation, lists], names=out.names)

    return rows.mapInArrow(run, out)


def components_table(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component, numbered from 1."""
    model = fit(vectors, vec_col=vec_col)
    rows = whiten(vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("embedding")), model)
    explained = F.array(*[F.lit(x) for x in model.explained()]) if model else F.array().cast("array<double>")
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"))
