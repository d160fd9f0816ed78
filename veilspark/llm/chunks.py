"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 32 characters marks a cut where its top bits are zero, so
chunks follow the content and an insertion moves only the cuts next to it.  Chunks have at least
`MIN_CHUNK` and at most `MAX_CHUNK` characters, about 24 on average.  A chunk's 128-bit digest is
its identity: of equal chunks the one in the row of least hash stays.  Digests are grouped with
their least and greatest row before the shuffle, so a chunk that a third of all rows hold costs one
partial row per task; only chunks of several rows are joined back, by plain joins that adaptive
execution may split.  Within a row, adjoining repeated chunks form runs, and runs of `min_chars` or
more are passages to remove; shorter ones are common phrases and stay.

Since the chunks at both ends of a passage reach into its surroundings, a run is shorter than its
passage; the default of 80 is for passages of 50 words (the share that is found stands in the README).

Defined results: a null or empty text has no chunks; texts are chunked whole; rows that are equal
in id and text count as one row here and stay alike; chunks that come back within one row are
repeats too, the first one stays; offsets are code points, ends exclusive; extra columns pass
through and may have any name.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import broadcast_if_small, free_name, materialize, plain, row_key, small_batches, whole
from veilspark.llm.decontaminate import with_length

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 8, 96, 4
MIN_CHARS = 80
WINDOW = 32
BLOCK_CHARS = 1_000_000
SPANS = "array<struct<start:int,end:int>>"
CHUNK = "row long, start int, end int, d1 long, d2 long, again boolean"


def gear(points: np.ndarray) -> np.ndarray:
    """A pseudo-random 32-bit value for every code point; 0 for the padding, -1."""
    with np.errstate(over="ignore"):
        x = (points.astype(np.int64) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def rolling(values: np.ndarray) -> np.ndarray:
    """hash[i] = sum of values[i-k] << k over the last 32 values, by doubling the window."""
    h = values.copy()
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    return h


def cut_places(marks: list[int], size: int) -> list[int]:
    """Ends of the chunks of a text, from the places after which the hash allows a cut."""
    ends, last = [], 0
    for m in marks:
        if m - last < MIN_CHUNK:
            continue
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK:
            last = m
            ends.append(m)
    while size - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if size > last:
        ends.append(size)
    return ends


def chunk_ends(texts: list[str]) -> list[list[int]]:
    """Chunk ends of every text; the texts are hashed together, with padding between them."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + WINDOW) - sizes
    points = np.full(int((sizes + WINDOW).sum()), -1, dtype=np.int64)
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    points[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = np.flatnonzero((rolling(gear(points)) >> np.uint32(32 - CUT_BITS)) == 0) + 1
    bounds = np.searchsorted(marks, np.stack([starts + 1, starts + sizes + 1]))
    return [
        cut_places((marks[a:b] - s).tolist(), n)
        for a, b, s, n in zip(*bounds.tolist(), starts.tolist(), sizes.tolist())
    ]


def chunk_table(rows: DataFrame) -> DataFrame:
    """(row, start, end, d1, d2, again) for every chunk of (row, text); `again` if the row had it before."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys = list(plain(batch["text"])), batch["row"].to_numpy()
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK_CHARS or i == len(texts) - 1:
                    yield _chunk_frame(texts[begin : i + 1], keys[begin : i + 1])
                    begin, size = i + 1, 0

    return rows.mapInPandas(run, CHUNK)


def _chunk_frame(texts: list[str], keys: np.ndarray) -> pd.DataFrame:
    ends = chunk_ends(texts)
    digest = xxhash.xxh3_128_digest
    digests, again = [], []
    for t, e in zip(texts, ends):
        own = [digest(t[a:b].encode("utf-8", "surrogatepass")) for a, b in zip([0, *e], e)]
        seen: set[bytes] = set()
        for d in own:
            again.append(d in seen)
            seen.add(d)
        digests += own
    counts = [len(e) for e in ends]
    d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    all_ends = np.array([x for e in ends for x in e], dtype=np.int32)
    starts = np.array([x for e in ends for x in [0, *e][: len(e)]], dtype=np.int32)
    return pd.DataFrame({"row": np.repeat(keys, counts), "start": starts, "end": all_ends, "d1": d[:, 0], "d2": d[:, 1], "again": np.array(again, dtype=bool)})


def runs(chunks: Iterable[tuple[int, int]], min_chars: int) -> list[tuple[int, int]]:
    """Adjoining chunks as runs of `min_chars` or more."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if b - a >= min_chars]


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, removed, shared) for rows with repeated passages.

    `shared` are the spans that also stand elsewhere, `removed` the ones of which another occurrence stays.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(row_key(id_col, text_col).alias("row"), whole(F.col(f"`{text_col}`")).alias("text"))
    table = chunk_table(rows)
    own = table.where("not again")
    digests = own.groupBy("d1", "d2").agg(F.min("row").alias("keeper"), F.max("row").alias("most")).where("keeper <> most")
    digests = materialize(digests.select("d1", "d2", "keeper"), "digests")
    shared = own.join(digests, ["d1", "d2"]).select("row", "start", "end", (F.col("row") != F.col("keeper")).alias("gone"))
    found = shared.unionByName(table.where("again").select("row", "start", "end", F.lit(True).alias("gone")))
    spans = found.distinct().groupBy("row").agg(F.collect_list(F.struct("start", "end", "gone")).alias("chunks"))

    @F.pandas_udf(f"struct<removed:{SPANS},shared:{SPANS}>")
    def join(lists: pd.Series) -> pd.DataFrame:
        as_spans = lambda x: [{"start": a, "end": b} for a, b in x]
        return pd.DataFrame({
            "removed": [as_spans(runs(((c["start"], c["end"]) for c in x if c["gone"]), min_chars)) for x in lists],
            "shared": [as_spans(runs(((c["start"], c["end"]) for c in x), min_chars)) for x in lists],
        })

    return spans.select("row", join.asNondeterministic()("chunks").alias("s")).select("row", "s.*").where(F.size("shared") > 0)


def _width(spans: str):
    return F.aggregate(F.coalesce(F.col(spans), F.array().cast(SPANS)), F.lit(0).cast("long"), lambda acc, s: acc + (s.end - s.start))


def repeat_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: its characters, those in repeated passages, those removed, and the spans."""
    found = repeats(docs, id_col=id_col, text_col=text_col, **options)
    ids = docs.select(row_key(id_col, text_col).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                      F.length(whole(F.col(f"`{text_col}`"))).cast("long").alias("n_chars"))
    return ids.join(found, "row", "left").select(
        "doc_id", "n_chars", _width("shared").alias("n_repeated"), _width("removed").alias("n_removed"),
        F.col("shared").isNotNull().alias("repeated"),
        F.coalesce("shared", F.array().cast(SPANS)).alias("repeated_spans"),
        F.coalesce("removed", F.array().cast(SPANS)).alias("removed_spans"),
    )


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without repeated passages; every document stays; columns of `docs`."""
    row, removed = free_name(docs, "chunk_row"), free_name(docs, "chunk_removed")
    gone = repeats(docs, id_col=id_col, text_col=text_col, **options).where(F.size("removed") > 0)
    gone = broadcast_if_small(materialize(gone.select(F.col("row").alias(row), F.col("removed").alias(removed)), "gone"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(texts, spans):
            if x is not None and len(x):
                edges = [0, *(e for s in x for e in (s["start"], s["end"])), len(t)]
                t = "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = docs.join(gone, row_key(id_col, text_col) == F.col(row), "left")
    return with_length(joined.withColumn(text_col, cut(F.col(f"`{text_col}`"), F.col(removed))), text_col).select(*docs.columns)
