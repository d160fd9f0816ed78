"""Benchmark decontamination: a broadcast hash set of test n-grams scanned over training text.

A document's words are mapped to the benchmark's word numbers, a rolling hash of every window
is looked up in the sorted hashes of the benchmark's windows, and each hit is verified against
the words themselves.  Documents are never shuffled as long as the benchmark fits into one
slice of `slice_chars`; a larger one is scanned slice by slice and the findings of a document
are put together by its id.

Defined results: a null or empty text has no words and no hits; an item without words has no
windows; an item with fewer words than a window is one window; a null item id hits but is not
listed; equal items and repeated rows are all found; extra columns are not read.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import ALNUM_WORD, ASCII_LOWER, alnum_words, free_name, plain, small_batches, whole

WINDOW = 10
SLICE_CHARS = 32_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPANS = "array<struct<start:int,end:int>>"
FOUND = f"struct<n_words:long,hits:{_SPANS},items:array<string>>"


@dataclass
class WindowIndex:
    """The windows of one slice of the benchmark."""

    words: dict[bytes, int]
    hashes: dict[int, np.ndarray]  # by window length, sorted
    items: dict[bytes, tuple]  # word numbers of a window -> item ids


def rolling_hash(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every window of `size` word numbers."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    x = ids.astype(np.uint64) + np.uint64(2)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + x[k : k + n]
        return out ^ (out >> np.uint64(29))


def build_index(rows, window: int = WINDOW) -> WindowIndex:
    """rows: (item id, text)."""
    words: dict[bytes, int] = {}
    items: dict[bytes, set] = {}
    hashes: dict[int, list[np.ndarray]] = {}
    for item, text in rows:
        ids = np.array([words.setdefault(w, len(words)) for w in alnum_words(text or "")], dtype=np.int32)
        if not len(ids):
            continue
        size = min(window, len(ids))
        hashes.setdefault(size, []).append(rolling_hash(ids, size))
        for i in range(len(ids) - size + 1):
            items.setdefault(ids[i : i + size].tobytes(), set()).add(item)
    return WindowIndex(
        words,
        {size: np.unique(np.concatenate(parts)) for size, parts in hashes.items()},
        {key: tuple(sorted(str(i) for i in found if i is not None)) for key, found in items.items()},
    )


def find_hits(text: str, index: WindowIndex) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, merged runs of hit words (end exclusive) and ids of the items found."""
    words = alnum_words(text)
    get = index.words.get
    ids = np.array([get(w, -1) for w in words], dtype=np.int32)
    found: set[str] = set()
    spans: list[tuple[int, int]] = []
    for size, known in index.hashes.items():
        h = rolling_hash(ids, size)
        if not len(h):
            continue
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        for i in np.flatnonzero(known[at] == h).tolist():
            hit = index.items.get(ids[i : i + size].tobytes())
            if hit is not None:
                found.update(hit)
                spans.append((i, i + size))
    return len(words), merged(spans), sorted(found)


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_chars: int):
    """The benchmark's rows, in slices of about `slice_chars` characters by a hash of the row."""
    rows = benchmark.select(F.col(item_col).alias("item"), whole(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // slice_chars) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield rows if n == 1 else rows.where(part == k)


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
         slice_chars: int = SLICE_CHARS) -> DataFrame:
    """All columns of `docs` and `found`: struct(n_words, hits, items).

    With several slices the findings of each are put together per row of `docs`, by its id and
    text, so ids may repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = free_name(docs, "found")
    frames = []
    for rows in _slices(benchmark, item_col, item_text_col, slice_chars):
        index = spark.sparkContext.broadcast(build_index(((r.item, r.text) for r in rows.toLocalIterator()), window))

        @F.pandas_udf(FOUND)
        def look(texts: pd.Series) -> pd.DataFrame:
            out = [find_hits(t, index.value) for t in plain(texts)]
            return pd.DataFrame({
                "n_words": [n for n, _, _ in out],
                "hits": [[{"start": a, "end": b} for a, b in spans] for _, spans, _ in out],
                "items": [ids for _, _, ids in out],
            })

        frames.append(docs.select("*", look.asNondeterministic()(F.col(text_col)).alias(found)))
    if len(frames) == 1:
        return frames[0]
    key = [F.col(id_col).alias("key"), F.xxhash64(whole(text_col)).alias("digest")]
    parts = frames[0].select(*key, found)
    for frame in frames[1:]:
        parts = parts.unionByName(frame.select(*key, found))

    @F.pandas_udf(_SPANS)
    def merge(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in merged((s["start"], s["end"]) for s in x)] for x in lists])

    each = parts.groupBy("key", "digest").agg(
        F.max(f"{found}.n_words").alias("n_words"),
        F.flatten(F.collect_set(f"{found}.hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"{found}.items")))).alias("items"),
    )
    key_name, digest_name = free_name(docs, "row_key"), free_name(docs, "row_digest")
    each = each.select(
        F.col("key").alias(key_name), F.col("digest").alias(digest_name),
        F.struct("n_words", merge("hits").alias("hits"), "items").alias(found),
    )
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key_name)) & (F.xxhash64(whole(text_col)) == F.col(digest_name))
    return docs.join(each, same).drop(key_name, digest_name)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated and the hit runs."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(options.pop("text_col", "text")).alias("text"))
    n_hit = F.aggregate("found.hits", F.lit(0).cast("long"), lambda acc, s: acc + (s.end - s.start))
    return scan(docs, benchmark, **options).select(
        "doc_id", "found.n_words", n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (F.size("found.hits") > 0).alias("contaminated"),
        F.col("found.hits").alias("hit_runs"),
    )


def cut_runs(text: str, runs) -> str:
    """The text without the given runs of words; what stands between two words of a run goes too."""
    at = [m.span() for m in ALNUM_WORD.finditer(text.translate(ASCII_LOWER))]
    out, last = [], 0
    for start, end in runs:
        out.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", remove: str = "spans",
                  max_share: float = 0.5, **options) -> DataFrame:
    """The documents without benchmark text, with the columns of `docs`.

    remove="documents" drops each document with a hit; remove="spans" cuts the hit words out and
    drops a document only if more than `max_share` of its words were hit.  `n_chars`, if there,
    follows the new text.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    scanned = scan(docs, benchmark, text_col=text_col, **options)
    found = next(c for c in scanned.columns if c not in docs.columns)
    hits, words = F.col(f"`{found}`.hits"), F.col(f"`{found}`.n_words")
    if remove == "documents":
        return scanned.where(F.size(hits) == 0).drop(found)
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda acc, s: acc + (s.end - s.start))

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([cut_runs(t, [(r["start"], r["end"]) for r in rs]) if len(rs) else t for t, rs in zip(texts, runs)], dtype=object)

    kept = scanned.where(n_hit <= max_share * words)
    kept = kept.withColumn(text_col, F.when(F.size(hits) > 0, cut(F.col(text_col), hits)).otherwise(F.col(text_col)))
    return with_length(kept, text_col).select(*docs.columns)


def with_length(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`n_chars`, where the frame has it, counted anew."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
