"""Redaction of a corpus-wide list of known values, by one automaton over all of them.

`redact.redact_by_findings` takes a list per document and cuts the text once for each value.  Here one list holds for
every document and may have very many values: they become one Aho-Corasick automaton, which finds all
occurrences of all values in one pass over a text.  Overlapping occurrences are settled as there: longer values
first, equally long ones in their order, from left to right.

The list is counted before it is shipped.  Up to `MAX_CHARS` characters it goes to the workers as one broadcast, and
texts are not shuffled.  A longer list is cut into slices by hash; each slice is shipped, its occurrences are stored, and
its broadcast is given up before the next one, so driver and workers hold one slice at a time.

Defined results: empty and null values are not looked for; a value that is there with several types takes the
first of them in order; a null text stays null, with no replacements; repeated rows get equal answers.
"""
from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators.files import file_type
from veilspark.operators.redact import DEFAULT_TEMPLATE, TEMPLATES
from veilspark.session import write_through

#: Characters of the values of one automaton; one takes some 40 bytes a character.
MAX_CHARS = 4_000_000
_FOUND = "array<struct<start:int,end:int,type:string>>"


def build_automaton(values: Iterable[tuple[str, str]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for value, kind in values:
        machine.add_word(value, (len(value), kind))
    if len(machine):
        machine.make_automaton()
    return machine


def occurrences(text: str, machine) -> list[tuple[int, int, str]]:
    """(start, end, type) of every occurrence of every value, overlapping ones too."""
    if not len(machine):
        return []
    return [(end + 1 - size, end + 1, kind) for end, (size, kind) in machine.iter(text)]


def settle(text: str, found: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The disjoint occurrences that are replaced, by place."""
    taken: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(set(found), key=lambda o: (o[0] - o[1], text[o[0] : o[1]], o[0])):
        k = bisect_left(taken, (end,))
        if not k or taken[k - 1][1] <= start:
            insort(taken, (start, end, kind))
    return taken


def rebuild(text: str, taken: list[tuple[int, int, str]], template: str) -> str:
    out, last = [], 0
    for start, end, kind in taken:
        out += [text[last:start], template.replace("{t}", kind)]
        last = end
    return "".join([*out, text[last:]])


def _settled(texts: pd.Series, kinds: pd.Series, found: Iterable[list]) -> pd.DataFrame:
    rows = []
    for text, kind, spans in zip(texts, kinds, found):
        if text is None:
            rows.append((None, 0))
        else:
            taken = settle(text, spans)
            rows.append((rebuild(text, taken, TEMPLATES.get(kind, DEFAULT_TEMPLATE)), len(taken)))
    return pd.DataFrame(rows, columns=["redacted_text", "redaction_count"]).astype({"redaction_count": "int32"})


def redact_values(docs: DataFrame, values: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """Adds `file_type`, `redacted_text` and `redaction_count` to `docs` (path and text) by `values` (type, value)."""
    spark = docs.sparkSession
    listed = values.where(F.length("value") > 0).groupBy("value").agg(F.min("type").alias("type"))
    listed = write_through(spark, listed, "known_values")
    chars = listed.agg(F.sum(F.length("value").cast("long"))).first()[0] or 0
    slices = max(1, math.ceil(chars / max_chars))
    typed = docs.withColumn("file_type", file_type(F.col("path")))
    result = T.StructType([*typed.schema.fields, T.StructField("redacted_text", T.StringType()), T.StructField("redaction_count", T.IntegerType())])

    def ship(k: int):
        part = listed if slices == 1 else listed.where(F.pmod(F.xxhash64("value"), F.lit(slices)) == k)
        return spark.sparkContext.broadcast([(r.value, r.type) for r in part.toLocalIterator()])

    if slices == 1:
        shipped = ship(0)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = build_automaton(shipped.value)
            for frame in frames:
                found = (occurrences(t, machine) if t is not None else [] for t in frame[text])
                yield pd.concat([frame, _settled(frame[text], frame["file_type"], found)], axis=1)

        return typed.mapInPandas(run, result)

    keyed = typed.select(F.xxhash64(text).alias("h1"), F.md5(F.col(text)).alias("h2"), F.col(text).alias("body"))
    parts = None
    for k in range(slices):
        shipped = ship(k)

        def look(frames: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            machine = build_automaton(shipped.value)
            for frame in frames:
                found = [[{"start": a, "end": b, "type": c} for a, b, c in occurrences(t, machine)] if t is not None else [] for t in frame["body"]]
                yield frame[["h1", "h2"]].assign(found=found)

        part = keyed.mapInPandas(look, f"h1 long, h2 string, found {_FOUND}").where(F.size("found") > 0)
        part = write_through(spark, part, "occurrences")
        shipped.destroy()
        parts = part if parts is None else parts.unionByName(part)
    # equal texts have equal occurrences: one row of each slice is enough
    merged = parts.groupBy("h1", "h2").agg(F.flatten(F.collect_set("found")).alias("_found"))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = ([(s["start"], s["end"], s["type"]) for s in x] if x is not None else [] for x in frame["_found"])
            yield pd.concat([frame.drop(columns="_found"), _settled(frame[text], frame["file_type"], found)], axis=1)

    same = (F.xxhash64(F.col(f"d.`{text}`")) == F.col("m.h1")) & (F.md5(F.col(f"d.`{text}`")) == F.col("m.h2"))
    joined = typed.alias("d").join(merged.alias("m"), same, "left").select("d.*", "m._found")
    return joined.mapInPandas(finish, result)
