import pytest
from pyspark.sql import functions as F

from tests.test_detect import by_hand, frame, noisy_texts
from veilspark.operators import detect as D
from veilspark.operators import redact as R
from veilspark.operators import vault as V
from veilspark.operators.search import search_sanitized


def islands(spans):
    out = []
    for s, e, c, p in sorted(((s, e, c, p) for s, e, c, p, _ in spans), key=lambda x: (x[0], -x[1], x[3])):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, c])
    return out


def clean_by_hand(text, dedupe=False):
    at, out, counts, seen = 0, [], {}, {}
    for s, e, c in islands(by_hand(text)):
        value = text[s:e]
        if not (dedupe and (c, value) in seen):
            counts[c] = counts.get(c, 0) + 1
            seen[c, value] = counts[c]
        out += [text[at:s], f"__{c}_{seen[c, value] if dedupe else counts[c]}__"]
        at = e
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("dedupe", [False, True])
def test_sanitize_like_by_hand(spark, dedupe):
    texts = noisy_texts(800, seed=3) + ["", "plain é😀", "a@b.com x a@b.com y c@d.com"]
    rows = R.sanitize(frame(spark, texts), dedupe=dedupe).collect()
    assert {r.doc_id: r.sanitized_text for r in rows} == {
        i: clean_by_hand(t, dedupe) for i, t in enumerate(texts)
    }


def test_a_document_with_very_many_hits(spark):
    text = " é ".join(f"10.{i // 65536 % 256}.{i // 256 % 256}.{i % 256} u{i}@ex.com" for i in range(20000))
    row = R.sanitize(frame(spark, [text])).first()
    assert row.redaction_count == 40000
    assert row.sanitized_text == clean_by_hand(text)


def test_table_form_equals_row_form(spark):
    many = " ".join(f"u{i}@ex.com" for i in range(5000))
    docs = frame(spark, [*noisy_texts(300, seed=5), many, many + " é😀", "😀é a@b.com 😀"])
    a = {r.doc_id: r.sanitized_text for r in R.sanitize(docs).collect()}
    b = {r.doc_id: r.sanitized_text for r in R.sanitize_tables(docs, R.assign_placeholders(docs)).collect()}
    assert a == b


def test_no_original_survives_and_rehydrate_is_identity(spark):
    docs = frame(spark, noisy_texts(300, seed=9))
    clean = R.sanitize(docs)
    vault = V.build_vault(R.placeholder_rows(clean).withColumn("added_at", F.lit(0)))
    back = {r.doc_id: r.restored_text for r in V.rehydrate(clean.select("doc_id", "sanitized_text"), vault).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    again = D.detect(clean.select("doc_id", F.col("sanitized_text").alias("text"))).where("category = 'EMAIL'")
    assert again.count() == 0


def test_rehydrate_tells_1_from_10(spark):
    docs = spark.createDataFrame([(1, "__EMAIL_10__ __EMAIL_1__ __EMAIL_11__")], "doc_id long, sanitized_text string")
    vault = spark.createDataFrame(
        [(1, "__EMAIL_1__", "one"), (1, "__EMAIL_10__", "ten"), (2, "__EMAIL_11__", "other")],
        "scope_id long, placeholder string, original string",
    )
    assert V.rehydrate(docs, vault).first().restored_text == "ten one __EMAIL_11__"


def test_vault_last_write_wins_and_hides_originals(spark):
    rows = spark.createDataFrame(
        [(1, "__EMAIL_1__", "old", "EMAIL", 1), (1, "__EMAIL_1__", "new", "EMAIL", 2), (2, "__EMAIL_1__", "x", "EMAIL", 1)],
        "doc_id long, placeholder string, original string, category string, added_at long",
    )
    vault = V.build_vault(rows)
    assert {(r.scope_id, r.original) for r in vault.collect()} == {(1, "new"), (2, "x")}
    assert "original" not in V.lookup(vault.select("scope_id", "placeholder"), vault).columns
    report = V.policy_report(vault, {"k": "v"}).collect()
    assert {(r.section, r.name, r.placeholder, r.entries) for r in report} == {
        ("vault", "EMAIL", "__EMAIL_1__", 2), ("policy", "k", "v", 0),
    }


@pytest.mark.parametrize("dedupe", [False, True])
def test_corpus_scope_with_one_hot_category(spark, dedupe):
    texts = [f"u{i % 7}@x.com 10.0.0.{i % 3}" if i % 5 else "p" + "q" * 3 for i in range(300)]
    got = R.assign_placeholders(frame(spark, texts), scope="corpus", dedupe=dedupe)
    rows = sorted((r.doc_id, r.start, r.category, r.original, r.placeholder) for r in got.collect())
    counts, seen, want = {}, {}, []
    for i, t in enumerate(texts):
        for s, e, c in islands(by_hand(t)):
            v = t[s:e]
            if not (dedupe and (c, v) in seen):
                counts[c] = counts.get(c, 0) + 1
                seen[c, v] = counts[c]
            want.append((i, s, c, v, f"__{c}_{seen[c, v] if dedupe else counts[c]}__"))
    assert rows == sorted(want)


def test_findings_longest_first_by_file_type(spark):
    docs = spark.createDataFrame(
        [(1, "/a.txt", "Ann Annabel"), (2, "/a.csv", "Ann"), (3, "/a.html", "Ann"), (4, "/a.py", "Ann"), (5, "/a.json", "x"), (6, "/a.bin", "Ann")],
        "doc_id long, path string, text string",
    )
    findings = spark.createDataFrame(
        [(i, "NAME", "Ann") for i in (1, 1, 2, 3, 4, 6)] + [(1, "FULL", "Annabel")], "doc_id long, type string, value string"
    )
    got = {r.doc_id: r.redacted_text for r in R.redact_by_findings(docs, findings).collect()}
    assert got == {
        1: "[REDACTED: NAME] [REDACTED: FULL]", 2: "[REDACTED]",
        3: '<span class="redacted" data-type="NAME">[REDACTED]</span>', 4: '"[REDACTED_NAME]"',
        5: "x", 6: "[REDACTED: NAME]",
    }


def test_replay_edits(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "keep")], "doc_id long, text string")
    edits = spark.createDataFrame(
        [(1, 1, 1, "a", "X", False, False), (1, 2, 1, "b", "Y", True, True), (1, 2, 2, "a", "Z", False, False), (1, 3, 1, "X", "late", False, False),
         (1, 1, 2, "", "never", True, False), (2, 40, 1, "keep", "kept", True, False)],
        "doc_id long, turn long, seq int, old_string string, new_string string, replace_all boolean, done boolean",
    )
    got = {r.doc_id: r.edited_text for r in R.replay_edits(docs, edits).collect()}
    assert got == {1: "X Y Z Y", 2: "kept"}
    capped = {r.doc_id: r.edited_text for r in R.replay_edits(docs, edits, max_turns=15).collect()}
    assert capped[2] == "keep"


def test_values_are_not_found_in_replacements(spark):
    docs = spark.createDataFrame([(1, "a.html", "sport and sp"), (2, "a.txt", "NAXY NA xNA"), (3, "a.txt", r"a\Qb\E a\E")], "doc_id long, path string, text string")
    findings = spark.createDataFrame(
        [(1, "NAME", "sport"), (1, "PART", "sp"), (1, "NONE", "absent"), (2, "NAME", "NAXY"), (2, "PART", "NA"), (3, "ODD", r"a\Qb\E")],
        "doc_id long, type string, value string")
    got = {r.doc_id: (r.redacted_text, r.redaction_count) for r in R.redact_by_findings(docs, findings).collect()}
    span = '<span class="redacted" data-type="{}">[REDACTED]</span>'
    assert got == {
        1: (span.format("NAME") + " and " + span.format("PART"), 2),
        2: ("[REDACTED: NAME] [REDACTED: PART] x[REDACTED: PART]", 3),
        3: (r"[REDACTED: ODD] a\E", 1),
    }


def test_model_findings(spark):
    docs = frame(spark, ["a@b.com"] * 6)
    good = '{"sanitized_text":"x","redactions":[{"type":"NAME","placeholder":"__NAME_1__","context":"Ann"},{"placeholder":"__P_1__"}]}'
    answers = spark.createDataFrame(
        [(0, good), (1, "```json\n" + good + "\n```"), (2, good[:-4]), (3, '{"sanitized_text":""}'), (4, "no json")], "doc_id long, raw string"
    )
    rows = R.merge_model_findings(docs, answers).collect()
    methods = {r.doc_id: r.method for r in rows}
    assert methods == {0: "llm+regex", 1: "llm+regex", 2: "regex-only", 3: "regex-only", 4: "regex-only", 5: "regex-only"}
    model = sorted((r.doc_id, r.category, r.original) for r in rows if r.origin == "model")
    assert model == [(i, c, v) for i in (0, 1) for c, v in (("HIGH_ENTROPY", "(redacted)"), ("NAME", "Ann"))]


def test_patch_lines(spark):
    docs = frame(spark, ["1\n2\n3\n4\n5", "a\nb", "untouched\n", "one"])
    ranges = spark.createDataFrame(
        [(0, 2, 3), (0, 3, 4), (0, -5, 1), (1, 2, 99), (3, 5, 9)], "doc_id long, start_line int, end_line int"
    )
    rows = {r.doc_id: r for r in R.patch_lines(docs, ranges, "r", marker="[{}]").collect()}
    assert rows[0].patched_text == "[r]\n[r]\n[r]\n[r]\n5" and rows[0].lines_redacted == 4
    assert rows[1].patched_text == "a\n[r]" and rows[1].backup_text == "a\nb"
    assert rows[2].patched_text == "untouched\n" and rows[2].backup_text is None
    assert rows[3].patched_text == "one" and rows[3].lines_redacted == 0 and rows[3].backup_text == "one"


def test_search_caps_per_file_and_cleans(spark):
    files = spark.createDataFrame(
        [(1, "/c/a.txt", "hit a@b.com\nno\n  hit 2 \nhit 3\n"), (2, "/c/.env", "hit"), (3, "/x/b.txt", "hit"), (4, "/c/b.txt", "none")],
        "doc_id long, path string, text string",
    )
    rows = search_sanitized(files, "^ *hit", ["/c"], max_results=2).orderBy("line").collect()
    assert [(r.path, r.line, r.snippet, r.file_matches) for r in rows] == [
        ("/c/a.txt", 1, "hit __EMAIL_1__", 3), ("/c/a.txt", 3, "hit 2", 3),
    ]
    many = spark.createDataFrame([(1, "/c/m.txt", "\n".join(f"hit {k}" for k in range(100)))], "doc_id long, path string, text string")
    assert search_sanitized(many, "^hit", ["/c"]).count() == 100
    empty = search_sanitized(files.where("doc_id = 1"), "^$", ["/c"]).collect()
    assert empty == []
