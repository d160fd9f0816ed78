import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from veilspark.llm import pieces as P

TEXTS = [
    "", " ", "Hello  world ", "  a", "a▁b ▁", "\n\nx\ty", "é… naïve", "x" * 300, "ab1" * 200 + " " * 40 + "z",
    "日本語 テキスト 執", "emoji 😀😀 ok", "<s> </s> <0x41>", " \x00\x7f", "12345 67.89", " " * 200,
]


@pytest.fixture(scope="module")
def model():
    return P.load_pieces()


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiourstlnéü") for _ in range(r.randint(1, 14))) for _ in range(n))


def naive(p, text, key, seed, rate):
    """One merge at a time over the whole text, no agendas."""
    if not text:
        return []
    mixed = np.frombuffer(P.hashlib.blake2b(str(seed).encode(), digest_size=8).digest(), dtype=np.uint64)[0]
    keys = np.full(1, key, dtype=np.int64).view(np.uint64)
    cps = [ord(c) for c in " " + text]
    sym = [(int(p.first[c]), i) for i, c in enumerate(cps)]
    while True:
        best = None
        for j in range(len(sym) - 1):
            (a, i), (b, _) = sym[j], sym[j + 1]
            if a < 0 or b < 0:
                continue
            r, v = P._candidates(p, np.array([a]), np.array([b]), np.array([i]), keys, mixed, rate)
            if r[0] != P._NONE and (best is None or r[0] < best[0]):
                best = (int(r[0]), j, int(v[0]))
        if best is None:
            break
        sym[best[1] : best[1] + 2] = [(best[2], sym[best[1]][1])]
    out = []
    for s, i in sym:
        out += [s] if 0 <= s < p.n_pieces else [int(p.byte_ids[b]) for b in chr(cps[i]).encode()]
    return out


def test_rate_zero_is_the_models_own_segmentation(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    texts = [t for t in TEXTS if "▁" not in t and "\x00" not in t and "<" not in t] + [words(60, s) for s in range(5)]
    got = P.encode_texts(model, texts, np.arange(len(texts)))
    for t, ids in zip(texts, got):
        assert ids.tolist() == sp.encode(t), t


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_every_rate_decodes_and_equals_one_merge_at_a_time(model, rate):
    texts = TEXTS + [words(12, 3)]
    got = P.encode_texts(model, texts, np.arange(len(texts)), seed=7, rate=rate)
    for k, (t, ids) in enumerate(zip(texts, got)):
        assert P.decode_ids(model, ids.tolist()) == t
        if len(t) <= 300:
            assert ids.tolist() == naive(model, t, k, 7, rate), t[:40]


def test_seed_and_key_vary_the_cut(model):
    t = words(50, 1)
    a, b = P.encode_texts(model, [t, t], [1, 2], seed=1, rate=0.2)
    (c,) = P.encode_texts(model, [t], [1], seed=2, rate=0.2)
    (d,) = P.encode_texts(model, [t], [1], seed=1, rate=0.2)
    assert a.tolist() == d.tolist() and a.tolist() != b.tolist() and a.tolist() != c.tolist()


def test_a_word_of_100_000_characters(model):
    t = "".join(random.Random(2).choice("abcdefgh") for _ in range(100_000))
    (ids,) = P.encode_texts(model, [t], [1], seed=1, rate=0.1)
    assert P.decode_ids(model, ids.tolist()) == t


def test_frames(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS) if "\x00" not in t] + [(None, None, 1), (2, TEXTS[2], 2), (2, TEXTS[2], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, trip int")
    out = P.round_trip(docs).collect()
    assert len(out) == len(rows) and all(r.lossless for r in out)
    assert [r.n_tokens for r in out if r.doc_id is None] == [0]
    assert len({r.tokens_sha256 for r in out if r.doc_id == 2}) == 1
    back = P.decode(P.encode(docs)).where(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))))
    assert back.count() == 0
    assert P.round_trip(docs.limit(0)).count() == 0
