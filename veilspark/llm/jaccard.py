"""N-gram Jaccard join: MinHash banding, verification on full n-gram sets.

1. Documents with the same words in the same order are one class, held by its least row.
2. A class's set of word n-grams is hashed to `bands x rows` minima; the numbers are chosen so that
   a pair at the threshold shares a band with the target probability.  Classes are shuffled on
   band hashes, and each is linked to the least class of its bucket: a linear number of links.
3. Connected classes form a candidate cluster, so every pair that shares a bucket is in one.
   A cluster is cut into blocks of bounded size by the order of set sizes, and one task verifies
   one pair of blocks on the full n-gram sets.  Block pairs whose sizes rule out the threshold are
   never made.  What leaves a task is the number of links per class and a spanning forest of
   them, not the pairs; so a group of near copies costs time, but no rows.
4. The forests' components are the groups of near copies.

Defined results: words are split at white space and compared as they are; a text with fewer words
than an n-gram has them all as its only n-gram; a null or empty text, or one without words, has no
links and is a class of its own; equal texts are one class and count as copies, not as links;
rows that are equal in id and text stay separate rows with equal results; extra columns are not read.
"""
from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import free_name, materialize, plain, small_batches, whole
from veilspark.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
BLOCK = 512
BLOCK_GRAMS = 400_000
SEED = 20
SIGNATURE = "struct<digest:string,n:int,bands:array<long>>"


def choose_bands(threshold: float, recall: float, max_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows per band, which sets the least work, that reach the recall at the threshold."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            return bands, rows
    return max_hashes, 1


def ngram_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    intern: dict[bytes, int] = {}
    ids = np.array([intern.setdefault(w, len(intern)) for w in words], dtype=np.int64)
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in intern], dtype=np.uint64)[ids]
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ each[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        out += np.uint64(size)
    return np.unique(out)


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band over the minima of `rows` hash functions."""
    a, b = _multipliers(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 1024):
            part = grams[None, at : at + 1024] * a[:, None]
            part += b[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(rows):
            out = (out ^ (low[k::rows] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _text_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(row, doc_id, n, cls, bands): the class digest of every document with words."""

    @F.pandas_udf(SIGNATURE)
    def sign(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in plain(texts):
            words = _text_words(t)
            grams = ngram_hashes(words, n)
            digest = xxhash.xxh3_128_hexdigest(b" ".join(words)) if words else None
            out.append((digest, len(grams), band_hashes(grams, bands, rows) if words else []))
        return pd.DataFrame(out, columns=["digest", "n", "bands"])

    return docs.select("row", "doc_id", sign.asNondeterministic()(F.col("text")).alias("s")).select(
        "row", "doc_id", F.coalesce("s.digest", F.concat(F.lit("-"), F.col("row").cast("string"))).alias("digest"),
        F.col("s.n").alias("n"), F.col("s.bands").alias("bands"),
    )


def _links_in_blocks(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float):
    """Links (i, j) between two blocks of n-gram sets, or within one.

    Only n-grams that both sides hold are laid out as columns; the shared counts come from
    products of 0/1 matrices, some thousand columns at a time.
    """
    sets = left if right is None else left + right
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, dtype=bool)
    column = np.cumsum(new) - 1
    count = np.bincount(column) if len(column) else np.empty(0, dtype=np.int64)
    shared = count[column] > 1 if len(column) else np.empty(0, dtype=bool)
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    n_left = len(left)
    both = np.zeros((n_left, n_left if right is None else len(right)), dtype=np.float32)
    total = int(column.max()) + 1 if len(column) else 0
    edges = np.searchsorted(column, np.arange(0, total + 4096, 4096))
    for k in range(len(edges) - 1):
        o, c = owner[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * 4096
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[o, c] = 1
        both += m[:n_left] @ (m if right is None else m[n_left:]).T
    a, b = sizes[:n_left, None], (sizes if right is None else sizes[n_left:])[None, :]
    # shared >= threshold * union, as whole numbers scaled by a million to keep ties exact
    millionths = round(threshold * 1_000_000)
    shared_n = both.astype(np.int64)
    linked = (shared_n * 1_000_000 >= millionths * (a + b - shared_n)) & (shared_n > 0)
    if right is None:
        linked = np.triu(linked, 1)
    return np.nonzero(linked)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links."""
    parent = list(range(n))
    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[y] = x
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: `class_id`, `n_copies`, `n_links`, `group_id`, `group_size`, `is_kept`.

    `class_id` is the least id with the same words, `n_copies` the size of that class, `n_links` the
    number of other classes with a similarity of `threshold` or more, `group_id` the least id of the
    class's connected group, `group_size` its documents; `is_kept` marks one row of each group.
    """
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    base = _base(docs, id_col, text_col)
    signed = materialize(_signatures(base, n, bands, rows), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = signed.groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("n_copies"))
    classes = materialize(classes.select("digest", "f.row", "f.doc_id", "n_copies"), "classes")
    members = signed.where("n > 0").join(classes.select("row"), "row", "left_semi")
    keyed = members.select("row", F.posexplode("bands").alias("band", "hash"))
    buckets = keyed.groupBy("band", "hash").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last")
    stars = keyed.join(buckets, ["band", "hash"]).where("row <> first").select(
        F.col("row").alias("a"), F.col("first").alias("b"))
    clusters = components(stars)
    links = materialize(_verify(base, signed, clusters, n, threshold, block), "links")
    counts = links.where("other is null").groupBy("row").agg(F.sum("n_links").alias("n_links"))
    groups = components(links.where("other is not null").select(F.col("row").alias("a"), F.col("other").alias("b")))
    each = classes.join(counts, "row", "left").join(groups, F.col("row") == F.col("node"), "left").select(
        "digest", "row", F.col("doc_id").alias("class_id"), "n_copies",
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "row").alias("component"))
    each = materialize(each, "classes")
    first = F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "row"))
    by_group = each.groupBy("component").agg(first.alias("f"), F.sum("n_copies").alias("group_size"))
    each = each.drop("row").join(by_group, "component")
    out = signed.select("row", "doc_id", "digest").join(each, "digest")
    return out.select(
        "row", "doc_id", "class_id", "n_copies", "n_links", F.col("f.class_id").alias("group_id"), "group_size",
        (F.col("row") == F.col("f.row")).alias("is_kept"))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text); `row` stands for the id and text together, as ids may repeat or be null."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole(F.col(f"`{text_col}`")).alias("text"))
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _verify(base: DataFrame, signed: DataFrame, clusters: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """(row, other, n_links): the links of each class within its cluster, as counts, and a forest of them.

    Blocks follow set sizes: a class falls into a size band of its cluster, and bands so far apart
    that no two sets can reach the threshold are not compared.  Within a size band a hash deals
    the classes over as many blocks as keep each near `block`.
    """
    # bands of a factor 1/threshold: a link joins equal or neighbouring bands
    size_band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold) if threshold < 1 else 1e-9)).cast("int")
    inside = signed.select("row", "n").join(clusters, F.col("row") == F.col("node")).select(
        "row", "n", "component", size_band.alias("band")).distinct()
    inside = materialize(inside, "inside")
    shape = inside.groupBy("component", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("s") / BLOCK_GRAMS)).cast("int")
    shape = shape.select("component", "band", blocks.alias("blocks"))
    beside = shape.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = shape.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    shape = shape.join(beside, ["component", "band"], "left").join(below, ["component", "band"], "left").na.fill(0)
    # Which tasks a class goes to: pairs (i, j) of blocks in its band, and pairs with the bands beside.
    mine = F.pmod(F.xxhash64(F.lit(7), "row"), F.col("blocks")).cast("int")
    task = "array<struct<band:int,step:int,i:int,j:int,side:int>>"
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.col("band").alias("band"), F.lit(0).alias("step"), F.least(k, F.col("mine")).alias("i"),
        F.greatest(k, F.col("mine")).alias("j"), F.when(k < F.col("mine"), 1).otherwise(0).alias("side"))).cast(task)
    none = F.array().cast(task)
    up = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda k: F.struct(
        F.col("band").alias("band"), F.lit(1).alias("step"), F.col("mine").alias("i"), k.alias("j"), F.lit(0).alias("side"))).cast(task)).otherwise(none)
    down = F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda k: F.struct(
        (F.col("band") - 1).alias("band"), F.lit(1).alias("step"), k.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"))).cast(task)).otherwise(none)
    dealt = inside.join(shape, ["component", "band"]).withColumn("mine", mine).select(
        "row", "component", F.concat(own, up, down).alias("tasks"))
    texts = base.select("row", "text").join(dealt, "row")

    @F.pandas_udf("array<long>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([ngram_hashes(_text_words(t), n).view(np.int64) for t in plain(texts)], dtype=object)

    sets = texts.select("row", "component", "tasks", grams.asNondeterministic()(F.col("text")).alias("grams"))
    work = sets.select("row", "component", F.explode("tasks").alias("t"), "grams").select("row", "component", "t.*", "grams")

    def verify(key: tuple[Any, ...], batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates("row").sort_values("row", kind="stable")
        step, i, j = key[2], key[3], key[4]
        sides = batch["side"].to_numpy()
        one = step == 0 and i == j
        first = np.ones(len(batch), dtype=bool) if one else sides == 0
        sets = [np.asarray(g).view(np.uint64) for g in batch["grams"]]
        rows = batch["row"].to_numpy()
        at_left, at_right = np.flatnonzero(first), np.flatnonzero(~first)
        left = [sets[k] for k in at_left]
        a, b = _links_in_blocks(left, None if one else [sets[k] for k in at_right], threshold)
        a = at_left[a]
        b = at_left[b] if one else at_right[b]
        count = np.bincount(np.concatenate([a, b]).astype(np.int64), minlength=len(rows))
        linked = np.flatnonzero(count)
        forest = _forest(a, b, len(rows))
        out = pd.DataFrame({"row": rows[linked], "other": None, "n_links": count[linked]})
        tree = pd.DataFrame({"row": [rows[x] for x, _ in forest], "other": [rows[y] for _, y in forest], "n_links": 0})
        both = pd.concat([out.astype(object), tree.astype(object)], ignore_index=True)
        return both.astype({"row": "int64", "other": "Int64", "n_links": "int64"})

    return work.groupBy("component", "band", "step", "i", "j").applyInPandas(verify, "row long, other long, n_links long")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each group the row with the least id; columns of `docs`.

    Of rows that are equal in id and text one stays.
    """
    found = materialize(near_copies(docs, id_col=id_col, text_col=text_col, **options), "copies")
    name, row = free_name(docs, "gone"), F.xxhash64(F.col(f"`{id_col}`"), whole(F.col(f"`{text_col}`")))
    gone = found.where("not is_kept").select(F.col("row").alias(name))
    rest = docs.join(gone, row == F.col(name), "left_anti")
    if found.where("is_kept").count() > found.where("is_kept").select("row").distinct().count():
        rest = rest.dropDuplicates([id_col, text_col])  # some rows are there twice, id and text alike
    return rest
