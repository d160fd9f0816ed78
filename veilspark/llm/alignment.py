"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how usual that is.

1. A whole text is encoded by both tokenizers.  Token bytes must join to a space and the text; a text for
   which they do not (normalised characters, unknown pieces) has no tokens.
2. Anchors: byte offsets where tokens of both end and the next token of both begins with a space.
   They cut the document into windows, pairs of id tuples.  An anchor is verified by the byte offsets, so
   what lies between two of them depends on the ids alone.
3. A window's alignment is worked out once and kept per worker: its groups (cut where tokens of
   both end) and its links (pairs of tokens whose bytes overlap).  A document's alignment is that of its
   windows, one after the other.
4. Links are counted by document over the corpus: each document's distinct pairs are stored with their
   number, counted per pair before they are shuffled, and the counts joined back.  The most frequent pairs, at
   most `FREQUENT` of them, are broadcast; rarer ones, of which none is in very many
   documents, are joined by a shuffle.

Defined results: a null or empty text has no tokens, and zeros; a text of any length is aligned
whole; every row is a document, so repeated rows count repeatedly and give equal answers; ids may be null; other
columns are not read.
"""
from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import materialize, small_batches, whole

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed: the split pattern that belongs to the vocabulary, and its special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = re.compile(r"\s{2000}")
END_OF_TEXT = "<|endoftext|>"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Windows that a worker remembers; then it starts anew.  A window and its alignment take about 1 KB.
MEMO = 400_000
OF_B = 1 << 24
#: Pairs that may be broadcast, of 8 + 8 + 1 bytes each.
FREQUENT = 1_000_000
BATCH = 256


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for
    characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The tokenizer A: ids of a text behind a space, and the bytes of every id.

    Its vocabulary is read from the file, where ids are merge ranks; the encoder is the one that
    takes ranks, which gives the same ids several times as fast and has no special tokens to mistake.
    Its pattern engine stops at very long white space, so texts with such runs go to the file's own tokenizer.
    """

    def __init__(self, path: str = BYTE_BPE):
        import tiktoken

        alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if all(c in alphabet for c in token) and token != END_OF_TEXT}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.path, self.slow = path, None
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_slowly(t) if LONG_SPACE.search(t) else self.encoding.encode_ordinary(" " + t) for t in texts]

    def join(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def encode_slowly(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """The tokenizer B: ids of a text, which it puts a space before, and the bytes of every id."""

    def __init__(self, path: str = PIECES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def links_of(a: list[int], b: list[int], width_a, width_b, name_a, name_b) -> tuple[int, str, list[int]]:
    """Groups of two token sequences over the same bytes: their number, their written form, and the links
    as packed pairs.

    Both are walked by their ends: the token that ends first gives way to its successor, until both
    end together.  No token is without bytes.
    """
    written, links = [], []
    i = j = 0
    while i < len(a):
        x, y = a[i], b[j]
        at_a, at_b = name_a[x], name_b[y]
        end_a, end_b = width_a[x], width_b[y]
        links.append(x << 32 | y)
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                x = a[i]
                end_a += width_a[x]
                at_a = f"{at_a},{name_a[x]}"
            else:
                j += 1
                y = b[j]
                end_b += width_b[y]
                at_b = f"{at_b},{name_b[y]}"
            links.append(x << 32 | y)
        i += 1
        j += 1
        written.append(f"{at_a}|{at_b}")
    return len(written), ";".join(written), links


class Memo(dict):
    """Window -> its alignment, worked out when it is first asked for.

    A window is its id tuples in one: the ids of A, then those of B with `OF_B` added, four bytes each.
    """

    def __init__(self, *tables):
        super().__init__()
        self.tables = tables

    def __missing__(self, key: bytes) -> tuple[int, str, list[int]]:
        ids, n = memoryview(key).cast("I").tolist(), 0
        while ids[n] < OF_B:
            n += 1
        found = self[key] = links_of(ids[:n], [i - OF_B for i in ids[n:]], *self.tables)
        return found


class Aligner:
    """Aligns documents by windows between anchors, and remembers windows."""

    def __init__(self, a: ByteLevel, b: Pieces, memo: int = MEMO):
        self.a, self.b, self.limit = a, b, memo
        width_a, width_b = ([len(x) for x in t.bytes] for t in (a, b))
        self.len_a, self.len_b = np.array(width_a), np.array(width_b)
        self.mark_a, self.mark_b = (np.array([x.startswith(b" ") for x in t.bytes]) for t in (a, b))
        self.memo = Memo(width_a, width_b, *([str(i) for i in range(len(t.bytes))] for t in (a, b)))

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in both sequences before which an anchor lies, with their starts and ends."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        # only starts of space-marked tokens are candidates; the byte offsets must be the same
        at_a, at_b = np.flatnonzero(self.mark_a[a[1:]]), np.flatnonzero(self.mark_b[b[1:]])
        offset_a, offset_b = ends_a[at_a], ends_b[at_b]
        place = np.searchsorted(offset_b, offset_a)
        same = np.flatnonzero(np.append(offset_b, -1)[place] == offset_a)
        return np.concatenate([[0], at_a[same] + 1, [len(a)]]), np.concatenate([[0], at_b[place[same]] + 1, [len(b)]])

    def align(self, text: str, a: list[int], b: list[int]) -> tuple[int, str, dict[int, int]] | None:
        """Groups, their written form, and the links with their numbers; None if the bytes differ."""
        raw = b" " + text.encode("utf-8", "surrogatepass")
        if self.a.join(a) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return None
        a, b, memo = np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32), self.memo
        at_a, at_b = self.anchors(a, b)
        # window after window, the ids of A before those of B
        both = np.empty(len(a) + len(b), dtype=np.uint32)
        both[np.arange(len(a)) + np.repeat(at_b[:-1], np.diff(at_a))] = a
        both[np.arange(len(b)) + np.repeat(at_a[1:], np.diff(at_b))] = b + np.uint32(OF_B)
        packed, cuts = both.tobytes(), (4 * (at_a + at_b)).tolist()
        keys = [packed[i:j] for i, j in zip(cuts, cuts[1:])]
        if len(memo) >= self.limit:
            memo.clear()
        sizes, written, pairs = zip(*[memo[key] for key in keys])
        return sum(sizes), ";".join(written), Counter(chain.from_iterable(pairs))


def alignments(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE,
               b_path: str = PIECES, memo: int = MEMO, digest: bool = False) -> DataFrame:
    """One row per document: id, tokens of both, number of groups, the groups written out (`a1,a2|b1;a3|b2`,
    or with `digest` the SHA-256 of that, '' without tokens), and the distinct links as arrays `pairs` (id
    of A * 2^32 + id of B) and `times`."""
    small_batches(docs.sparkSession, BATCH)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole(F.col(f"`{text_col}`")).alias("text"))
    out = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()), T.StructField("groups", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteLevel(a_path), Pieces(b_path), memo)
        gc.disable()  # millions of small tuples and no cycles
        try:
            for batch in batches:
                yield aligned(aligner, batch)
        finally:
            gc.enable()

    def aligned(aligner: Aligner, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        rows_ = []
        for text, a, b in zip(texts, aligner.a.encode(texts), aligner.b.encode(texts)):
            found = aligner.align(text, a, b) if text else None
            if found is None:
                rows_.append((0, 0, 0, "", [], []))
            else:
                n, form, links = found
                rows_.append((len(a), len(b), n, hashlib.sha256(form.encode()).hexdigest() if digest else form, list(links), list(links.values())))
        columns = list(zip(*rows_)) or [()] * 6
        types = (*[pa.int64()] * 3, pa.string(), *[pa.list_(pa.int64())] * 2)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=out.names)

    return rows.mapInArrow(run, out)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair, and whether that is the highest of its A id."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = materialize(counts, "pair_counts")
    of_a = F.shiftright("pair", 32).alias("a")
    best = counts.groupBy(of_a).agg(F.max("count").alias("highest"))
    joined = counts.select("pair", "count", of_a).join(best, "a")
    return materialize(joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pair_best")


def frequent_from(counts: DataFrame, limit: int) -> int:
    """The least power of two such that at most `limit` pairs are in as many documents; from 64 counters."""
    scale = {r.p: r.n for r in counts.groupBy(F.floor(F.log2("count")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, cut = 0, max(scale, default=0) + 1
    while cut > 0 and total + scale.get(cut - 1, 0) <= limit:
        cut -= 1
        total += scale.get(cut, 0)
    return 1 << cut


def align(docs: DataFrame, *, frequent: int = FREQUENT, **options) -> DataFrame:
    """The alignments of all documents with corpus-wide counts: `n_links`, `n_best` (links whose count is the
    highest of their A id) and `count_sum`, next to the columns of `alignments`."""
    # stored once: its rows get numbers that stay, and no later step encodes a text again
    stored = materialize(alignments(docs, **options).withColumn("row", F.monotonically_increasing_id()), "alignments")
    counts = pair_counts(stored)
    cut = frequent_from(counts, frequent)
    one = stored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    one = one.withColumnRenamed("pairs", "pair")
    per_row = lambda x: x.groupBy("row").agg(
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    common = F.broadcast(counts.where(F.col("count") >= cut))
    if cut == 1:
        sums = per_row(one.join(common, "pair"))
    else:
        marked = one.join(common, "pair", "left")
        rare = marked.where("count IS NULL").select("row", "pair", "times").join(counts.where(F.col("count") < cut).hint("merge"), "pair")
        both = per_row(marked.where("count IS NOT NULL")).unionByName(per_row(rare))
        sums = both.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    n_links = F.aggregate("times", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_links")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return stored.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", n_links, zero("n_best"), zero("count_sum"), "groups", "pairs", "times")


def alignment_report(docs: DataFrame, **options) -> DataFrame:
    """The counts of `align`, and its groups as a hash, '' for a document without tokens."""
    return align(docs, digest=True, **options).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
