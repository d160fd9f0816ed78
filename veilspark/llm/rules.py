"""Quality rules, line first: lines that look like menus, symbols or boilerplate go, then documents
that lose too much of their text.

Defined results: a null or empty text has no words and is rejected; a line without words is
neither kept text nor lost text; texts of any length are judged whole; rows are independent, so
repeated rows get equal answers; extra columns pass through.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import ASCII_SPACE, free_name, plain, small_batches
from veilspark.llm.decontaminate import with_length

SYMBOLS = "#*$%&|<>"
BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|released under|terms of (?:use|service)|privacy policy"
    r"|cookie policy|we use cookies|accept cookies|enable javascript|subscribe to our|sign up for our"
    r"|click here|read more|lorem ipsum",
    re.I,
)
ENDS = tuple(".!?:;…。！？\"'”’»)]}`")
JUDGED = (
    "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,"
    "lines_kept:long,lines_lost:long,lost_share:double,base_failed:boolean,kept:boolean,text:string>"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the two verdicts."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_words: float = 0.3  # share of a line's words that end in or are symbols
    max_separator_words: float = 0.2  # share of a line's words that are menu separators
    max_shouted: float = 0.7  # share of a line's words that end in "!!" or more
    min_words_unended: int = 5  # a line with fewer words must end in punctuation
    max_boilerplate_words: int = 20  # a longer line is more than its boilerplate phrase
    max_lost: float = 0.5  # share of a document's word characters that may be lost


_SYMBOL_END = re.compile(r"[#*$%&|<>]{2,}$")
_SEPARATORS = frozenset(["|", "||", "»", "›", "«", "‹", "·", "•", ">", "<", "::", "→", "/"])


def line_fails(words: list[str], line: str, rules: Rules) -> str | None:
    """The rule that a line with words breaks, or None."""
    n = len(words)
    if sum(w in _SEPARATORS for w in words) > rules.max_separator_words * n:
        return "navigation"
    if any(c in line for c in SYMBOLS) and sum(_SYMBOL_END.search(w) is not None for w in words) > rules.max_symbol_words * n:
        return "symbols"
    if "!!" in line and sum(w.endswith("!!") for w in words) > rules.max_shouted * n:
        return "shouting"
    if n <= rules.max_boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    if n < rules.min_words_unended and not line.rstrip(ASCII_SPACE).endswith(ENDS):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    m = np.uint64(len(seen))
    pair = ids[:-1] * m + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)
    triple = pair[:-1].astype(np.uint64) * m + ids[2:]
    _, at, count = np.unique(triple, return_inverse=True, return_counts=True)
    hit = np.zeros(n, dtype=bool)
    twice = count[at] > 1
    for k in range(3):
        hit[k : k + n - 2] |= twice
    return int(hit.sum())


def judge(text: str, rules: Rules) -> tuple:
    """One document's numbers, verdicts and cleaned text, in the order of `JUDGED`."""
    n_words = chars = lost = n_dup = lines_lost = 0
    seen: set[str] = set()
    kept: list[str] = []
    for line in text.split("\n"):
        words = line_words(line)
        if not words:
            kept.append(line)
            continue
        size = sum(map(len, words))
        n_words += len(words)
        chars += size
        n_dup += line in seen
        seen.add(line)
        if line_fails(words, line, rules):
            lost += size
            lines_lost += 1
        else:
            kept.append(line)
    n_symbols = sum(map(text.count, SYMBOLS))
    n_repeat = repeated_words(text.encode("utf-8", "surrogatepass").split())
    failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    share = lost / chars if chars else 0.0
    return (n_words, chars, n_symbols, n_dup, n_repeat, len(seen) + n_dup - lines_lost, lines_lost, share,
            failed, not failed and share <= rules.max_lost, "\n".join(kept))


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def line_words(line: str) -> list[str]:
    return _WORDS.findall(line)


def judged(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> tuple[DataFrame, str]:
    """`docs` with a struct column of `JUDGED`, and that column's name."""
    small_batches(docs.sparkSession)
    name = free_name(docs, "judged")
    fields = [f.split(":")[0] for f in JUDGED[7:-1].split(",")]

    @F.pandas_udf(JUDGED)
    def look(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, rules) for t in plain(texts)], columns=fields)

    return docs.select("*", look.asNondeterministic()(F.col(text_col)).alias(name)), name


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document with its counts and verdicts."""
    frame, name = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rules)
    extra = ["lines_kept", "lines_lost", "lost_share"]
    wide = frame.select("doc_id", f"{name}.*").drop("text")
    return wide.select(*[c for c in wide.columns if c not in extra], *extra)


def clean(docs: DataFrame, *, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with the lines that failed taken out; columns as in `docs`."""
    frame, name = judged(docs, text_col, rules)
    kept = frame.where(F.col(f"`{name}`.kept")).withColumn(text_col, F.col(f"`{name}`.text"))
    return with_length(kept, text_col).select(*docs.columns)
