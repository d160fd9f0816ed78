"""SentencePiece BPE with seeded merge-dropout, in lock-step over whole batches.

Every run of pieces that merges cannot leave (a word with the spaces in front of it) has its own
agenda of candidate merges, ordered by score and then from left to right.  A round pops the best
candidate of every agenda at once, with numpy; an agenda of more than `LONG` symbols is worked
off alone with a heap, so that a text without spaces stays near-linear.  A candidate is skipped
if a hash of (seed, document key, place, result) falls below the dropout rate: the same document
is always cut the same way, and rate 0 gives exactly the model's own segmentation.

Decoding is lossless for any text: characters that no piece holds, and the marker that stands
for a space, become byte pieces.

Defined results: a null or empty text has no tokens and decodes to the empty text; the key of a
document is the hash of its id, so rows with equal ids and texts get equal tokens and a null id is
a key like any other; texts are encoded whole; extra columns pass through.
"""
from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import free_name, plain, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 96
BLOCK_CHARS = 400_000
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Pieces:
    """A BPE model as arrays.  Symbols are piece ids, then characters that only occur inside pieces."""

    first: np.ndarray  # code point -> symbol, or -1
    keys: np.ndarray  # open-addressing table: left * n + right, or -1
    values: np.ndarray  # merged piece
    ranks: np.ndarray  # piece -> place in the order of merges
    n: int  # number of symbols
    n_pieces: int
    byte_ids: np.ndarray
    raw: list[bytes]  # piece -> what it decodes to


def load_pieces(path: str = MODEL) -> Pieces:
    """Read a BPE model file; done on the driver, the arrays are broadcast (a few MB)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(size)]
    usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(size)]
    ids = {p: i for i, p in enumerate(names) if usable[i]}
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("pieces that hold a space after other characters are not supported")
    byte_ids = np.full(256, -1, dtype=np.int32)
    for i in range(size):
        if sp.is_byte(i):
            byte_ids[int(names[i][3:5], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    symbols = dict(ids)
    for p in ids:
        for c in p:
            symbols.setdefault(c, size + len(symbols) - len(ids))
    n = size + len(symbols) - len(ids)
    pairs = {}
    for p, i in ids.items():
        for k in range(1, len(p)):
            left, right = symbols.get(p[:k]), symbols.get(p[k:])
            if left is not None and right is not None:
                pairs[left * n + right] = i
    first = np.full(0x110000, -1, dtype=np.int32)
    for c, i in symbols.items():
        if len(c) == 1:
            first[ord(c)] = i
    first[0x20], first[ord(SPACE)] = symbols[SPACE], -1
    _, ranks = np.unique(-np.array([sp.get_score(i) for i in range(size)]), return_inverse=True)
    bits = max(8, int(np.ceil(np.log2(max(1, len(pairs)) * 6))))
    keys, values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
    for key, value in pairs.items():
        slot = int(_slots(np.array([key], dtype=np.int64), bits)[0])
        while keys[slot] != -1:
            slot = (slot + 1) & ((1 << bits) - 1)
        keys[slot], values[slot] = key, value
    raw = [
        bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() if usable[i] else b""
        for i, p in enumerate(names)
    ]
    return Pieces(first, keys, values, ranks.astype(np.int32), n, size, byte_ids, raw)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _candidates(p: Pieces, left, right, place, key, seed: np.uint64, rate: float):
    """Rank and result of merging each pair; the rank is `_NONE` where nothing merges or it is skipped."""
    size = len(p.keys)
    want = left.astype(np.int64) * p.n + right
    slot = _slots(want, size.bit_length() - 1)
    held = p.keys[slot]
    result = np.where(held == want, p.values[slot], -1).astype(np.int32)
    open_ = np.flatnonzero((held != want) & (held != -1))
    while len(open_):
        slot[open_] = (slot[open_] + 1) & (size - 1)
        held = p.keys[slot[open_]]
        hit = held == want[open_]
        result[open_[hit]] = p.values[slot[open_[hit]]]
        open_ = open_[~hit & (held != -1)]
    result[(left < 0) | (right < 0)] = -1
    ok = np.flatnonzero(result >= 0)
    if rate > 0 and len(ok):
        ok = ok[~skipped(place[ok], key[ok], result[ok], seed, rate)]
    rank = np.full(len(want), _NONE, dtype=np.int32)
    rank[ok] = p.ranks[result[ok]]
    return rank, result


def skipped(place, key, result, seed: np.uint64, rate: float) -> np.ndarray:
    """Whether the keyed hash of a candidate falls below the rate."""
    with np.errstate(over="ignore"):
        h = key ^ seed
        h = (h ^ (h >> np.uint64(30))) * _MIX2 + place.astype(np.uint64) * _MIX
        h = (h ^ (h >> np.uint64(27))) * _MIX2 + result.astype(np.uint64) * _MIX
        h = (h ^ (h >> np.uint64(31))) * _MIX2
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


def _heap_merge(p: Pieces, sym: np.ndarray, place: np.ndarray, key: np.uint64, seed, rate: float) -> np.ndarray:
    """One agenda alone: the symbols after all merges, -2 where a symbol went into the one before it."""
    n = len(sym)
    out = sym.astype(np.int64).copy()
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    keys = np.full(n - 1, key, dtype=np.uint64)
    rank, result = _candidates(p, sym[:-1], sym[1:], place[:-1], keys, seed, rate)
    ok = np.flatnonzero(rank != _NONE)
    heap = list(zip(rank[ok].tolist(), ok.tolist(), result[ok].tolist(), sym[ok].tolist(), sym[ok + 1].tolist()))
    heapq.heapify(heap)
    table, one = {}, np.ones(1, dtype=np.int32)

    def push(i: int) -> None:
        j = nxt[i]
        left, right = int(out[i]), int(out[j])
        if left < 0 or right < 0:
            return
        if (left, right) not in table:
            r, v = _candidates(p, one * left, one * right, place[i : i + 1], keys[:1], seed, 0.0)
            table[left, right] = (int(r[0]), int(v[0]))
        r, v = table[left, right]
        if r != _NONE and not (rate > 0 and skipped(place[i : i + 1], keys[:1], one * v, seed, rate)[0]):
            heapq.heappush(heap, (r, i, v, left, right))

    while heap:
        _, i, v, left, right = heapq.heappop(heap)
        j = nxt[i]
        if out[i] != left or j < 0 or out[j] != right:
            continue
        out[i], out[j] = v, -2
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
            push(i)
        if prev[i] >= 0:
            push(prev[i])
    return out


def _encode_block(p: Pieces, texts: list[str], doc_keys: np.ndarray, seed, rate: float) -> list[np.ndarray]:
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    total = int(sizes.sum())
    if not total:
        return [np.empty(0, dtype=np.int32) for _ in texts]
    points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sym = p.first[points]
    begins = np.zeros(total, dtype=bool)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    begins[offsets[:-1][sizes > 0]] = True
    space = sym == p.first[0x20]
    begins[1:] |= space[1:] & ~space[:-1]
    begins[1:] |= (sym[1:] < 0) | (sym[:-1] < 0)  # what no piece holds stands alone
    place = (np.arange(total) - np.repeat(offsets[:-1], sizes)).astype(np.int32)
    key = np.repeat(doc_keys, sizes)
    at = np.arange(total)
    seg = np.cumsum(begins)
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, total))
    out = np.full(total, -2, dtype=np.int32)
    long_ = np.flatnonzero(lengths > LONG)
    for s in long_.tolist():
        a, b = starts[s], starts[s] + lengths[s]
        out[a:b] = _heap_merge(p, sym[a:b], place[a:b], key[a], seed, rate)
    single = lengths == 1
    out[starts[single]] = sym[starts[single]]
    go = np.repeat(~single & (lengths <= LONG), lengths)
    sym, place, key, at, seg = sym[go], place[go], key[go], at[go], seg[go]
    if len(sym):
        _rounds(p, sym, place, key, at, seg, out, seed, rate)
    return _emit(p, out, points, offsets)


def _rounds(p: Pieces, sym, place, key, at, seg, out, seed, rate: float) -> None:
    """Merge the best candidate of every agenda until none has any; results go to `out`."""
    n = len(sym)
    rank, result = np.full(n, _NONE, dtype=np.int32), np.zeros(n, dtype=np.int32)
    same = np.flatnonzero(seg[1:] == seg[:-1])
    rank[same], result[same] = _candidates(p, sym[same], sym[same + 1], place[same], key[same], seed, rate)
    while n:
        starts = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
        best = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(n), starts)
        live = best >> 32 != _NONE
        keep = np.repeat(live, np.diff(np.append(starts, n)))
        done = ~keep
        out[at[done]] = sym[done]
        i = best[live] & 0xFFFFFFFF
        sym[i] = result[i]
        keep[i + 1] = False
        moved = (np.cumsum(keep) - 1)[i]
        sym, place, key, at, seg, rank, result = (x[keep] for x in (sym, place, key, at, seg, rank, result))
        n = len(sym)
        if not n:
            break
        rank[moved] = _NONE
        before = moved[moved > 0] - 1
        rank[before[seg[before] == seg[before + 1]]] = _NONE
        new = np.concatenate([moved, before])
        new = new[new + 1 < n]
        new = new[seg[new] == seg[new + 1]]
        rank[new], result[new] = _candidates(p, sym[new], sym[new + 1], place[new], key[new], seed, rate)


def _emit(p: Pieces, out, points, offsets) -> list[np.ndarray]:
    """Ids per document; symbols that are no pieces become the byte pieces of their character."""
    left = np.flatnonzero(out != -2)
    ids = out[left]
    counts = np.diff(np.searchsorted(left, offsets))
    odd = np.flatnonzero((ids < 0) | (ids >= p.n_pieces))
    if len(odd):
        byte_lists = [p.byte_ids[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), dtype=np.uint8)] for c in points[left[odd]].tolist()]
        widths = np.ones(len(ids), dtype=np.int64)
        widths[odd] = [len(b) for b in byte_lists]
        doc = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(widths)
        wide = np.repeat(ids, widths)
        for e, b in zip(ends[odd].tolist(), byte_lists):
            wide[e - len(b) : e] = b
        counts = np.bincount(doc, weights=widths, minlength=len(counts)).astype(np.int64)
        ids = wide
    return np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])


def encode_texts(p: Pieces, texts: list[str], doc_keys, seed: int = 0, rate: float = 0.0) -> list[np.ndarray]:
    """Token ids of each text."""
    keys = np.asarray(doc_keys, dtype=np.int64).view(np.uint64)
    mixed = np.frombuffer(hashlib.blake2b(str(seed).encode(), digest_size=8).digest(), dtype=np.uint64)[0]
    out: list[np.ndarray] = []
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= BLOCK_CHARS or i == len(texts) - 1:
            out += _encode_block(p, texts[begin : i + 1], keys[begin : i + 1], mixed, rate)
            begin, size = i + 1, 0
    return out


def decode_ids(p: Pieces, ids) -> str:
    """The text of token ids: pieces joined, the space in front of the text dropped."""
    raw = p.raw
    return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def _key(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
           seed: int = 1, rate: float = 0.1, out_col: str = "tokens") -> DataFrame:
    """`docs` with an array of token ids; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cut(keys: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(encode_texts(pieces.value, list(plain(texts)), keys.to_numpy(), seed, rate), dtype=object)

    return docs.withColumn(out_col, cut.asNondeterministic()(_key(id_col), F.col(text_col)))


def decode(frame: DataFrame, *, tokens_col: str = "tokens", model: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """`frame` with the text of its token ids; null tokens give the empty text."""
    small_batches(frame.sparkSession)
    pieces = frame.sparkSession.sparkContext.broadcast(load_pieces(model))

    @F.pandas_udf(T.StringType())
    def join(lists: pd.Series) -> pd.Series:
        return pd.Series([decode_ids(pieces.value, () if x is None else x) for x in lists], dtype=object)

    return frame.withColumn(out_col, join(F.col(tokens_col)))


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
               seed: int = 1, rate: float = 0.1) -> DataFrame:
    """One row per document: number of tokens, their digest, and whether they decode to the text."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    pieces = spark.sparkContext.broadcast(load_pieces(model))

    @F.pandas_udf("struct<n_tokens:long,tokens_sha256:string,lossless:boolean>")
    def trip(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        p, texts = pieces.value, list(plain(texts))
        ids = encode_texts(p, texts, keys.to_numpy(), seed, rate)
        return pd.DataFrame({
            "n_tokens": [len(x) for x in ids],
            "tokens_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids],
            "lossless": [decode_ids(p, x.tolist()) == t for x, t in zip(ids, texts)],
        })

    name = free_name(docs, "trip")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.select("doc_id", trip.asNondeterministic()(_key("doc_id"), F.col("text")).alias(name)).select("doc_id", f"{name}.*")
