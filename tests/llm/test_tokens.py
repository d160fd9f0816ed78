import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import tokens as T


def brute(text, sections, rule, encoder):
    """Tokens byte by byte."""
    owner = [k for k, s in enumerate(sections) for _ in s.encode()]
    counts, last = [0.0] * len(sections), 0
    for end in encoder.ends(text).tolist():
        own = owner[last:end]
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "last":
            counts[own[-1]] += 1
        elif rule == "largest":
            counts[max(dict.fromkeys(own), key=lambda k: (own.count(k), -k))] += 1
        else:
            for k in own:
                counts[k] += 1 / len(own)
        last = end
    assert last == len(owner)
    return counts


ROWS = [
    (1, "en", "a line\n\n\n\nand   another\n"),
    (2, None, ""),
    (3, "de", None),
    (None, "x\ny", "größe 😀\n\n\t\n日本語"),
    (5, "en", "\n" * 50 + "word" + "\n" * 7),
    (5, "en", "\n" * 50 + "word" + "\n" * 7),
    (6, "en", "ab " * 40_000),
]


@pytest.mark.parametrize("rule", T.RULES)
def test_counts_equal_byte_by_byte(spark, rule):
    docs = spark.createDataFrame([(i, a, b, 0) for i, a, b in ROWS], "doc_id long, lang string, text string, n_tokens int")
    got = {}
    for r in T.attribute(docs, fields=("lang", "text"), rule=rule).collect():
        got.setdefault((r.doc_id, r.start, r.field, r.section), []).append((r.n_tokens, r.n_chars))
    encoder = T.Encoder(T.read_ranks())
    for i, a, b in ROWS:
        fields = [("lang", a or ""), ("text", b or "")]
        lines = [(f, k, x + "\n") for f, v in fields for k, x in enumerate(v.split("\n"))]
        lines[-1] = (*lines[-1][:2], lines[-1][2][:-1])
        text = "".join(x for *_, x in lines)
        want = brute(text, [x for *_, x in lines], rule, encoder)
        at = 0
        for (f, k, x), n in zip(lines, want):
            assert all(abs(t - n) < 1e-6 and c == len(x) for t, c in got[(i, at, f, k)]), (i, f, k)
            at += len(x)


def test_sections_add_up(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = T.attribute(docs, fields=("text",)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    encoder = T.Encoder(T.read_ranks())
    want = {r.doc_id: len(encoder.ends(r.text)) for r in docs.collect()}
    assert {r.doc_id: int(r.n) for r in got} == want


def test_empty_table_and_bad_rule(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert T.attribute(docs, fields=("text",)).count() == 0
    with pytest.raises(ValueError):
        T.attribute(docs, rule="some")


def test_allocate_without_tokens():
    counts, crossing = T.allocate(np.empty(0, dtype=np.int64), np.array([0, 0]), "split")
    assert counts.tolist() == [0, 0] and crossing.tolist() == [0, 0]
