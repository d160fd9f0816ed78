"""The automaton against the job that takes a list per document, and against replacing by hand."""
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import known_values as K
from veilspark.operators import redact as R


def made(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé😀") for _ in range(rng.randint(1, 4)))
    values = sorted({word() for _ in range(25)} | {"aa", "aaa", "ab", "ba"})
    docs = [(i, f"/c/{i}{rng.choice(['.txt', '.html', '.csv', '.py', '.json'])}", "".join(rng.choice("ab é😀x") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    return docs + [(100, "/c/n.txt", None), (101, "/c/e.txt", ""), docs[0]], [(v, f"T{k % 3}") for k, v in enumerate(values)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, path string, text string")


@pytest.mark.parametrize("max_chars", [10**6, 20])
def test_equals_a_list_per_document(spark, max_chars):
    docs, values = made()
    listed = spark.createDataFrame([*values, ("", "T"), (None, "T"), (values[0][0], "Z")], "value string, type string")
    got = K.redact_values(frame(spark, docs), listed, max_chars=max_chars)
    assert got.columns == ["doc_id", "path", "text", "file_type", "redacted_text", "redaction_count"]
    each = spark.createDataFrame([(i, v, t) for i in {d[0] for d in docs} for v, t in values], "doc_id long, value string, type string")
    want = {(r.doc_id, r.redacted_text, r.redaction_count) for r in R.redact_by_findings(frame(spark, docs).dropDuplicates(), each).collect() if r.text is not None}
    rows = got.collect()
    assert len(rows) == len(docs) and {(r.doc_id, r.redacted_text, r.redaction_count) for r in rows if r.text is not None} == want
    assert [(r.redacted_text, r.redaction_count) for r in rows if r.text is None] == [(None, 0)]


def test_a_hundred_thousand_values(spark):
    values = spark.range(100_000).select(F.format_string("user-%06d@example.org", "id").alias("value"), F.lit("MAIL").alias("type"))
    docs = spark.range(300).select("id", F.lit("/c/x.txt").alias("path"), F.format_string("to user-%06d@example.org, cc user-%06d@example.org.", F.col("id") * 300, F.col("id") + 99_900).alias("text"))
    got = {r.id: (r.redacted_text, r.redaction_count) for r in K.redact_values(docs.withColumnRenamed("id", "id"), values).collect()}
    for i in range(300):
        second = "[REDACTED: MAIL]" if i + 99_900 < 100_000 else f"user-{i + 99_900:06d}@example.org"
        assert got[i] == (f"to [REDACTED: MAIL], cc {second}.", 1 + (i < 100))


def test_no_values_and_no_documents(spark):
    docs, values = made()
    none = spark.createDataFrame([], "value string, type string")
    assert {r.redaction_count for r in K.redact_values(frame(spark, docs), none).collect()} == {0}
    listed = spark.createDataFrame(values, "value string, type string")
    assert K.redact_values(frame(spark, docs).limit(0), listed).count() == 0


def test_settle_by_hand():
    text = "aaaa-abab"
    machine = K.build_automaton([("aa", "X"), ("aaa", "Y"), ("bab", "Z"), ("ab", "W")])
    assert K.settle(text, K.occurrences(text, machine)) == [(0, 3, "Y"), (6, 9, "Z")]
