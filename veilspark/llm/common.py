"""Helpers shared by the text operators."""
from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.session import write_through

# Rows that one Arrow batch may hold: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 1000

# Separators of words that are "anything but ASCII white space".
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not use yet, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let a batch that goes to a Python worker hold no more than `rows` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: lineage ends here."""
    return write_through(df.sparkSession, df, name)


def whole(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def plain(texts: pd.Series) -> Iterable[str]:
    """A batch of texts as Python strings; null is the empty text."""
    return ("" if t is None or t != t else t for t in texts)


#: Maps A-Z to a-z and every ASCII byte that is no letter or digit to a space; bytes of
#: other characters stay, so a translated UTF-8 text splits into its words at spaces.
ALNUM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = {b: b + 32 for b in range(65, 91)}


def alnum_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) runs of characters that are no ASCII punctuation, space or control."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_BYTES).split()


#: Rows that may be broadcast; more are joined by a shuffle.  With the row widths used here a
#: broadcast stays under about 64 MB.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored frame of narrow rows, marked for broadcast only if it was counted and is small."""
    return F.broadcast(df) if df.count() <= rows else df


def row_key(id_col: str, text_col: str) -> Column:
    """A number for a row's id and text together; ids may repeat or be null."""
    return F.xxhash64(F.col(f"`{id_col}`"), whole(F.col(f"`{text_col}`")))
