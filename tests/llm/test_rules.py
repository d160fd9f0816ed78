import re

from veilspark.llm import rules as R

GOOD = "This is a line of some eleven words that ends well."
LINES = {
    "Home | About | News | Contact | Login": "navigation",
    "a### b$$$ c%%% plain words": "symbols",
    "BUY!! NOW!! CHEAP!! ONLY!!": "shouting",
    "Released under the MIT License.": "boilerplate",
    "Read more": "boilerplate",
    "Chapter One": "punctuation",
    "Yes.": None,
    GOOD: None,
    "a long line without an end but with enough words in it": None,
}


def unlike(k):
    """A line that shares no word with another."""
    return " ".join(f"{w}{k}" for w in "these are seven words and an end".split()) + "."


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def test_each_line_rule():
    for line, rule in LINES.items():
        assert R.line_fails(R.line_words(line), line, R.Rules()) == rule, line


def test_counts_equal_brute_force(spark):
    texts = [None, "", " \n\t ", GOOD, "\n".join([GOOD] * 6), "a b c d a b c", "x " * 60, "é|ü &\x0b<z> q", "\n".join(f"{k} {GOOD}" for k in range(9)) + "\nMenu | a | b"]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(None, GOOD, 1, "k")], "doc_id long, text string, kept int, judged string")
    for r in R.quality_report(docs).collect():
        t = GOOD if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t


def test_given_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    got = {r.doc_id: r for r in R.quality_report(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(r.text)


def test_junk_goes_and_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = R.quality_report(docs).join(labels, "doc_id").collect()
    assert not any(r.kept for r in rows if r.quality == 0)
    assert all(r.kept for r in rows if r.quality == 1 and r.n_words >= 50)


def test_clean_takes_lines_out(spark):
    body = "\n".join(unlike(k) for k in range(9))
    rows = [(1, body + "\nHome | a | b | c\n\nend.", 5, "x"), (2, "Home | a | b", 5, "x"), (3, None, 5, "x"), (1, body, 5, "x"), (1, body, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, judged string")
    out = R.clean(docs)
    assert out.columns == docs.columns
    assert sorted((r.text, r.n_chars) for r in out.collect()) == sorted([(body + "\n\nend.", len(body) + 6), (body, len(body)), (body, len(body))])
    assert R.clean(docs.limit(0)).count() == 0 and R.quality_report(docs.limit(0)).count() == 0


def test_a_very_long_text():
    t = "\n".join(unlike(k) for k in range(40_000))
    assert R.judge(t, R.Rules())[9]
