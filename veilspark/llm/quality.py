"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts.  Training uses at most `max_rows` labelled rows (those
with the least hash of their id) outside the held-out third; they are the only rows that reach
the driver.  Features are cut into quantile bins, and every tree is grown level by level from
histograms of gradients.  The trees are complete, so a model is three arrays, and scoring walks
all trees of a batch at once with numpy.

Defined results: a null or empty text has zero statistics and is scored like any text; a document
is held out if crc32 of its id as text is 1 modulo 3, a null id counts as the empty text; labels
are 0 or 1, null labels and labels without a document are not used, a repeated label counts each
time; without labels every score is 0.5; repeated rows get equal scores; other columns are not read.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import plain, small_batches, whole
from veilspark.llm.rules import repeated_words

MAX_ROWS = 40_000
FEATURES = (
    "log_words", "mean_word", "sd_word", "long_words", "short_words", "upper", "digits", "symbols", "punctuation",
    "exclaimed", "pipes", "brackets", "beyond_ascii", "spaces", "lines", "words_per_line", "ended_lines", "repeated_lines",
    "distinct_words", "top_word", "top_ten", "repeated_windows", "alternating", "capital_words", "symbol_words",
)
_CLASS = np.zeros((10, 256), dtype=bool)
for _k, _chars in enumerate((
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"#*$%&|<>", b".,;:?!\"'()-", b"!", b"|", b"[]{}()<>",
    bytes(range(128, 256)), b" \t\n\r\x0b\x0c",
)):
    _CLASS[_k, list(_chars)] = True
_ENDS = tuple(".!?:;\"')…。！？")


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of `FEATURES`."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits, symbols, punctuation, exclaimed, pipes, brackets, beyond, spaces = (_CLASS @ counts).tolist()
    size = len(raw)
    width = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in text.split("\n") if x.strip()]
    tally = Counter(words)
    most = [c for _, c in tally.most_common(10)]
    same = sum(map(bytes.__eq__, words, words[1:]))
    two_apart = sum(map(bytes.__eq__, words, words[2:]))
    return [
        float(np.log1p(n)), float(width.mean()), float(width.std()), float((width > 12).mean()), float((width < 3).mean()),
        upper / max(1, upper + lower), digits / size, symbols / size, punctuation / size, exclaimed / n, pipes / n, brackets / n,
        beyond / size, spaces / size, float(np.log1p(len(lines))), float(np.log1p(n / max(1, len(lines)))),
        sum(x.rstrip().endswith(_ENDS) for x in lines) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        len(tally) / n, most[0] / n, sum(most) / n, repeated_words(words) / n, (same + two_apart) / n,
        sum(w[:1].isupper() for w in words) / n, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
    ]


@dataclass
class Trees:
    """Complete trees as arrays: inner nodes (trees, 2^depth - 1), leaves (trees, 2^depth)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features."""
        n, trees = len(x), len(self.feature)
        if not trees or not n:
            return np.full(n, 1 / (1 + np.exp(-self.start)))
        which, row = np.arange(trees)[None, :], np.arange(n)[:, None]
        node = np.zeros((n, trees), dtype=np.int64)
        inner = self.feature.shape[1]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[which, node]] > self.threshold[which, node])
        return 1 / (1 + np.exp(-(self.start + self.leaf[which, node - inner].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
          least_hessian: float = 2.0, l2: float = 1.0) -> Trees:
    """Boost `trees` trees on the logistic loss."""
    n = len(y)
    inner, leaves = 2**depth - 1, 2**depth
    if not n:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    # value <= cuts[b] exactly where its code is <= b
    at = codes + np.arange(width) * bins
    margin = np.full(n, start)
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        f_of, t_of = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * bins) + at).ravel()
            hist = lambda w: np.bincount(place, np.repeat(w, width), many * width * bins).reshape(many, width, bins)
            gs, hs = hist(g).cumsum(axis=2), hist(h).cumsum(axis=2)
            total_g, total_h = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
            gain[(hs < least_hessian) | (total_h - hs < least_hessian)] = 0
            flat = gain.reshape(many, -1)
            best = flat.argmax(axis=1)
            for k in np.flatnonzero(flat[np.arange(many), best] > 1e-6).tolist():
                f, b = divmod(int(best[k]), bins)
                if b < len(cuts[f]):
                    f_of[first + k], t_of[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), f_of[node]] > t_of[node])
        where = node - inner
        value = -rate * np.bincount(where, g, leaves) / (np.bincount(where, h, leaves) + l2)
        margin += value[where]
        feature.append(f_of)
        threshold.append(t_of)
        leaf.append(value)
    return Trees(np.array(feature), np.array(threshold), np.array(leaf), start)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded sample."""
    known = labels.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out("key"))
    sample = known.orderBy(F.xxhash64("key"), "key", "label").limit(max_rows)

    @F.pandas_udf("array<double>")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in plain(texts)], dtype=object)

    # the sample has at most `max_rows` rows of two numbers, so it may be broadcast
    joined = docs.select(F.col(f"`{id_col}`").alias("key"), whole(F.col(f"`{text_col}`")).alias("text")).join(F.broadcast(sample), "key")
    rows = joined.select("key", "label", F.xxhash64("text").alias("digest"), count.asNondeterministic()("text").alias("x"))
    # an id may stand for several texts: the bound holds for what is fitted, not only for the labels
    rows = rows.orderBy(F.xxhash64("key"), "key", "label", "digest").limit(max_rows).drop("digest")
    rows = rows.toPandas().sort_values(["key", "label"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # rows of one id may come in any order
    return x[order], rows["label"].to_numpy(dtype=float)[order]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_rows: int = MAX_ROWS, **options) -> Trees:
    """A model from the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    x, y = training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)
    return train(x, y, **options)


def score(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `held_out`, `score`, `predicted`."""
    spark = docs.sparkSession
    small_batches(spark)
    trees = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in plain(texts)], dtype=float).reshape(-1, len(FEATURES))
        return pd.Series(trees.value.score(x))

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("doc_id", held_out("doc_id").alias("held_out"), rate.asNondeterministic()("text").alias("score"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
