"""Token counts of fields and sections, from one encoding of the whole document.

A document is its fields joined by line ends, encoded once.  Its sections are the lines of each
field, a line end belonging to the line before it, so that they cover the document without gaps.
Token spans are joined to section spans by binary search; a token that crosses a boundary is
allocated by the rule:

    first     to the section of its first byte
    last      to the section of its last byte
    largest   to the section that holds most of its bytes, the earlier one of equals
    split     to all of them, by their share of its bytes

so the counts of a document's sections always add up to its tokens.

Defined results: a null field is an empty one; an empty field is one section, whose only
character is the line end behind it (none after the last field); repeated rows give repeated
rows; a null id is kept; a text of any length is encoded whole; columns that are not asked for
are not read.
"""
from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import small_batches, whole

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "largest", "split")


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Encodes a text once and gives the byte span of every token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """End offset, in bytes, of every token."""
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        return np.cumsum(self.width[ids])


def allocate(ends: np.ndarray, section_starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens per section.

    `section_starts` are byte offsets, the first one 0; empty sections share their start with the
    next one and get nothing.
    """
    n = len(section_starts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(section_starts, starts, side="right") - 1
    last = np.searchsorted(section_starts, ends - 1, side="right") - 1
    cross = np.flatnonzero(first != last)
    if rule == "last":
        counts = np.bincount(last, minlength=n).astype(float)
    else:
        counts = np.bincount(first, minlength=n).astype(float)
    crossing = np.zeros(n, dtype=np.int64)
    for t in cross.tolist():
        a, b = int(first[t]), int(last[t])
        edges = np.clip(np.append(section_starts[a : b + 1], ends[t]), starts[t], ends[t])
        shares = np.diff(edges)
        crossing[a : b + 1] += shares > 0
        if rule == "largest":
            counts[a] -= 1
            counts[a + int(shares.argmax())] += 1
        elif rule == "split":
            counts[a] -= 1
            counts[a : b + 1] += shares / (ends[t] - starts[t])
    return counts, crossing


def attribute(docs: DataFrame, *, id_col: str = "doc_id", fields: Sequence[str] = ("source", "lang", "text"),
              rule: str = "largest", ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """One row per section: document, field, number of the line in it, its span in characters, its tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    names = list(fields)
    columns = [whole(F.col(f"`{name}`").cast("string")).alias(f"f{i}") for i, name in enumerate(names)]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *columns)
    out = T.StructType([
        T.StructField("doc_id", rows.schema["id"].dataType),
        T.StructField("field", T.StringType()),
        T.StructField("section", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_tokens", T.DoubleType()),
        T.StructField("n_crossing", T.LongType()),
    ])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            parts: list[list] = [[] for _ in range(6)]
            per_doc = []
            for values in zip(*(batch[f"f{i}"] for i in range(len(names)))):
                lines, field, number = [], [], []
                for name, value in zip(names, values):
                    cut = value.split("\n")
                    lines += [x + "\n" for x in cut]
                    field += [name] * len(cut)
                    number.append(np.arange(len(cut)))
                lines[-1] = lines[-1][:-1]
                text = "".join(lines)
                size = np.array([len(x) for x in lines], dtype=np.int64)
                width = size if text.isascii() else np.array([len(x.encode("utf-8", "surrogatepass")) for x in lines], dtype=np.int64)
                counts, crossing = allocate(encoder.ends(text), np.cumsum(width) - width, rule)
                for part, x in zip(parts, (field, np.concatenate(number), np.cumsum(size) - size, size, counts, crossing)):
                    part.append(x)
                per_doc.append(len(lines))
            if per_doc:
                yield pd.DataFrame({
                    "doc_id": batch["id"].repeat(per_doc).reset_index(drop=True),
                    "field": [x for p in parts[0] for x in p],
                    **{name: np.concatenate(part) for name, part in zip(("section", "start", "n_chars", "n_tokens", "n_crossing"), parts[1:])},
                })

    return rows.mapInPandas(run, out)
