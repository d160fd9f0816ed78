"""Alignment against byte-by-byte ownership, counts against a count over all documents."""
import hashlib
from collections import Counter, defaultdict

import pytest

from veilspark.llm import alignment as A

SPECIAL = "a <|endoftext|> b </s> <s> <unk> <0x41> end"
ROWS = [
    (1, "The quick brown fox, 12345 jumps!"), (2, ""), (3, None), (None, "größe 😀\n\n\t\n日本語 naïve"), (5, SPECIAL), (5, SPECIAL),
    (6, "ab " * 20_000), (7, "   leading and   inner  spaces   "), (8, "a▁b"), (9, "ﬁne ½ x"), (10, "x" * 3000), (11, " "), (12, "\x00\x01 ﻿"),
    (13, "The quick brown fox"), (14, "a" + " " * 100_000 + "b"),
]


@pytest.fixture(scope="module")
def both():
    return A.ByteLevel(), A.Pieces()


def brute(rows, both):
    """Every document by the owner of each of its bytes in both tokenizations."""
    a, b = both
    docs, seen = [], Counter()
    for _, text in rows:
        raw = b" " + (text or "").encode()
        ids = [t.encode([text])[0] if text else [] for t in both]
        owners, ends = [], []
        for t, tokens in zip(both, ids):
            if b"".join(t.bytes[i] for i in tokens) != raw:
                owners = None
                break
            owners.append([k for k, i in enumerate(tokens) for _ in t.bytes[i]])
            last = {}
            for at, k in enumerate(owners[-1]):
                last[k] = at + 1
            ends.append(set(last.values()))
        if not owners or not text:
            docs.append(None)
            continue
        occurrences = sorted(set(zip(*owners)))
        groups, last = [], 0
        for end in sorted(ends[0] & ends[1]):
            ks, js = (sorted(set(o[last:end])) for o in owners)
            groups.append(",".join(str(ids[0][k]) for k in ks) + "|" + ",".join(str(ids[1][j]) for j in js))
            last = end
        links = [(ids[0][k], ids[1][j]) for k, j in occurrences]
        seen.update(set(links))
        docs.append((len(ids[0]), len(ids[1]), groups, links))
    highest = defaultdict(int)
    for (x, _), c in seen.items():
        highest[x] = max(highest[x], c)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, len(groups), len(links), sum(seen[x] == highest[x[0]] for x in links), sum(seen[x] for x in links),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, pairs int, row string")


def key(rows, values):
    return sorted((str(i), *v) for (i, _), v in zip(rows, values))


@pytest.mark.parametrize("frequent", [1_000_000, 20, 0])
def test_equals_byte_by_byte(spark, both, frequent):
    got = A.alignment_report(frame(spark, ROWS), frequent=frequent).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == key(ROWS, brute(ROWS, both))


def test_given_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = A.alignment_report(docs, memo=50).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == key(rows, brute(rows, both))


def test_groups_written_out_and_links(spark, both):
    rows = A.align(frame(spark, [(1, "The quick"), (2, "")])).collect()
    one = next(r for r in rows if r.doc_id == 1)
    ids = [[i for g in one.groups.split(";") for i in map(int, g.split("|")[s].split(","))] for s in (0, 1)]
    assert ids == [t.encode(["The quick"])[0] for t in both] and sum(one.times) == one.n_links


def test_windows_end_before_spaces_in_both(both):
    aligner = A.Aligner(*both)
    text = "some words, and\nmore  of them 😀 x"
    a, b = (t.encode([text])[0] for t in both)
    import numpy as np

    at_a, at_b = aligner.anchors(np.array(a), np.array(b))
    assert len(at_a) > 5
    for i, j in zip(at_a[1:-1], at_b[1:-1]):
        assert both[0].bytes[a[i]].startswith(b" ") and both[1].bytes[b[j]].startswith(b" ")
        assert sum(len(both[0].bytes[x]) for x in a[:i]) == sum(len(both[1].bytes[x]) for x in b[:j])


def test_encoder_equals_the_tokenizer_of_the_file(both):
    import random

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(A.BYTE_BPE)
    whole.encode_special_tokens = True
    rng = random.Random(2)
    points = [*range(0x3100), *(rng.randrange(0x3100, 0x110000) for _ in range(3000))]
    texts = [f"a{chr(c)}a {chr(c)} {chr(c)}{chr(c)}1{chr(c)} " for c in points if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choice(["ab", " ", "  ", "\n", "'s", "'", "é", "日", "12", ".,", "\u3000", SPECIAL]) for _ in range(30)) for _ in range(500)]
    texts += [" " * 5000, "x" * 5000, "\n" * 5000]
    want = [e.ids for e in whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert both[0].encode(texts) == want


def test_frequent_from(spark):
    counts = spark.createDataFrame([(i, c) for i, c in enumerate([1, 1, 1, 2, 3, 9])], "pair long, count long")
    assert [A.frequent_from(counts, n) for n in (6, 5, 3, 1, 0)] == [1, 2, 2, 4, 16]


def test_empty_table(spark):
    assert A.alignment_report(frame(spark, [])).count() == 0
