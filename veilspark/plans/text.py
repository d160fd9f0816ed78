"""Named queries: detection, redaction, vault, layout, search."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.operators import detect as D
from veilspark.operators import layout as L
from veilspark.operators import redact as R
from veilspark.operators.known_values import redact_values
from veilspark.operators import vault as V
from veilspark.operators.search import search_sanitized
from veilspark.plans import inputs as I
from veilspark.plans import sql_text as S
from veilspark.plans.catalog import query
from veilspark.session import write_through

CORPUS = f"corpus AS ({I.CORPUS_SQL})"
SPAN_COLUMNS = 'doc_id, category, value, start, "end"'


def _register_category(name: str, category: str) -> None:
    sql = f"WITH {CORPUS} SELECT {SPAN_COLUMNS} FROM ({S.category_sql(category, 'corpus')})"

    @query(name, sql)
    def run(spark, sf):
        return D.detect_category(I.corpus(spark, sf), category)


for _name, _category in (
    ("detect_ssn", "SSN"),
    ("detect_credit_card", "CREDIT_CARD"),
    ("detect_iban", "IBAN"),
    ("detect_phone", "PHONE"),
    ("detect_email", "EMAIL"),
    ("detect_ip", "IP_ADDRESS"),
    ("detect_secret", "SECRET"),
    ("detect_high_entropy", "HIGH_ENTROPY"),
):
    _register_category(_name, _category)

PAGES = "pages_text AS (SELECT page_id AS doc_id, url || chr(10) || html AS text FROM pages)"


@query("detect_url", f"WITH {PAGES} SELECT {SPAN_COLUMNS} FROM ({S.category_sql('URL', 'pages_text')})")
def detect_url(spark, sf):
    pages = I.table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.concat("url", F.lit("\n"), "html").alias("text")
    )
    return D.detect_category(I.spread(pages), "URL")


@query(
    "detect_all",
    f'WITH {CORPUS}, {S.detections_cte("corpus")} SELECT doc_id, category, priority, value, start, "end" FROM detections',
)
def detect_all(spark, sf):
    return D.detect(I.corpus(spark, sf))


@query(
    "detect_all_pages",
    f'WITH {PAGES}, {S.detections_cte("pages_text")} SELECT doc_id, category, priority, value, start, "end" FROM detections',
)
def detect_all_pages(spark, sf):
    pages = I.table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.concat("url", F.lit("\n"), "html").alias("text")
    )
    return D.detect(I.spread(pages))


@query("resolve_overlaps", f'WITH {CORPUS}, {S.merged_cte("corpus")} SELECT doc_id, category, start, "end" FROM merged')
def resolve_overlaps(spark, sf):
    return D.resolve_overlaps(D.detect(I.corpus(spark, sf)))


@query("merge_in_row", f'WITH {CORPUS}, {S.merged_cte("corpus")} SELECT doc_id, category, start, "end" FROM merged')
def merge_in_row(spark, sf):
    return D.merge_rows(I.corpus(spark, sf))


@query(
    "detection_profile",
    f"""
WITH {CORPUS}, {S.detections_cte("corpus")},
per_doc AS (
  SELECT c.lang, c.source, c.doc_id, d.category, count(*) AS hits
  FROM corpus c JOIN detections d ON c.doc_id = d.doc_id GROUP BY ALL
  UNION ALL
  SELECT c.lang, c.source, c.doc_id, 'ALL', count(d.doc_id)
  FROM corpus c LEFT JOIN detections d ON c.doc_id = d.doc_id GROUP BY ALL)
SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang,
       CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, category,
       sum(hits)::BIGINT AS hits, count(CASE WHEN hits > 0 THEN 1 END)::BIGINT AS docs_hit,
       CASE WHEN category = 'ALL' THEN round(count(CASE WHEN hits > 0 THEN 1 END) / count(*)::DOUBLE, 6) END AS hit_rate
FROM per_doc
GROUP BY GROUPING SETS ((category), (lang, category), (source, category), (lang, source, category))""",
)
def detection_profile(spark, sf):
    return D.detection_profile(I.corpus(spark, sf))


@query("scan_rules_pii", f"WITH {CORPUS} {S.rules_sql(P.PII_RULES, 'corpus')}")
def scan_rules_pii(spark, sf):
    return D.scan_rules(I.corpus(spark, sf), P.PII_RULES)


@query("scan_rules_secret", f"WITH {CORPUS} {S.rules_sql(P.SECRET_RULES, 'corpus')}")
def scan_rules_secret(spark, sf):
    return D.scan_rules(I.corpus(spark, sf), P.SECRET_RULES)


def _live_secret_sql(source: str) -> str:
    parts = []
    for rank, (name, pattern, known) in enumerate(P.LIVE_SECRET_RULES):
        fake = " OR ".join(f"contains(v, '{w}')" for w in P.LIVE_SECRET_FAKE_WORDS)
        listed = f" AND v NOT IN ({', '.join(S.quote(k) for k in known)})" if known else ""
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{name}' AS rule FROM (SELECT doc_id, unnest(regexp_extract_all(text, "
            f"{S.quote(P.sql_pattern(pattern))})) AS v FROM {source}) WHERE NOT ({fake}){listed} "
            f"AND len(list_distinct(regexp_extract_all(v, '(?s).'))) > {P.LIVE_SECRET_MAX_FAKE_CHARS}"
        )
    return "\nUNION ALL\n".join(parts)


@query(
    "scan_real_secret",
    f"""
WITH {CORPUS}, found AS ({_live_secret_sql("corpus")}),
firsts AS (SELECT doc_id, first(rule ORDER BY rank) AS rule FROM found GROUP BY doc_id)
SELECT c.doc_id, f.doc_id IS NOT NULL AS has_real_secret, f.rule FROM corpus c LEFT JOIN firsts f ON c.doc_id = f.doc_id""",
)
def scan_real_secret(spark, sf):
    return D.scan_real_secret(I.corpus(spark, sf))


MARK_COLUMNS = 'doc_id, category, original, start, "end", placeholder'


@query("assign_placeholders", f"WITH {CORPUS}, {S.marks_cte('corpus')} SELECT {MARK_COLUMNS} FROM marks")
def assign_placeholders(spark, sf):
    return R.assign_placeholders(I.corpus(spark, sf))




@query(
    "assign_placeholders_dedupe",
    f"""
WITH {CORPUS}, {S.marks_cte("corpus")},
firsts AS (SELECT doc_id, category, original, min(start) AS s FROM marks GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY s) AS n FROM firsts)
SELECT m.doc_id, m.category, m.original, m.start, m."end", '__' || m.category || '_' || r.n::VARCHAR || '__' AS placeholder
FROM marks m JOIN ranked r USING (doc_id, category, original)""",
)
def assign_placeholders_dedupe(spark, sf):
    return R.assign_placeholders(I.corpus(spark, sf), dedupe=True)


@query(
    "assign_placeholders_corpus",
    f"WITH {CORPUS}, {S.marks_cte('corpus', 'row_number() OVER (PARTITION BY category ORDER BY doc_id, start)')} SELECT {MARK_COLUMNS} FROM marks",
)
def assign_placeholders_corpus(spark, sf):
    return R.assign_placeholders(I.corpus(spark, sf), scope="corpus")


@query(
    "assign_placeholders_corpus_dedupe",
    f"""
WITH {CORPUS}, {S.marks_cte("corpus")},
firsts AS (SELECT category, original, min((doc_id, start)) AS f FROM marks GROUP BY ALL),
ranked AS (SELECT category, original, row_number() OVER (PARTITION BY category ORDER BY f) AS n FROM firsts)
SELECT m.doc_id, m.category, m.original, m.start, m."end", '__' || m.category || '_' || r.n::VARCHAR || '__' AS placeholder
FROM marks m JOIN ranked r USING (category, original)""",
)
def assign_placeholders_corpus_dedupe(spark, sf):
    return R.assign_placeholders(I.corpus(spark, sf), scope="corpus", dedupe=True)


@query("redact_text", f"WITH {CORPUS}, {S.sanitized_cte('corpus')} SELECT doc_id, sanitized_text FROM sanitized")
def redact_text(spark, sf):
    return R.redact_text(R.with_marks(I.corpus(spark, sf))).select("doc_id", "sanitized_text")


@query(
    "sanitize",
    f"WITH {CORPUS}, {S.sanitized_cte('corpus')} SELECT doc_id, sanitized_text, redaction_count, 'regex-only' AS method FROM sanitized",
)
def sanitize(spark, sf):
    return R.sanitize(I.corpus(spark, sf)).select("doc_id", "sanitized_text", "redaction_count", "method")


@query(
    "sanitize_tables",
    f"WITH {CORPUS}, {S.sanitized_cte('corpus')} SELECT doc_id, sanitized_text, redaction_count FROM sanitized",
)
def sanitize_tables(spark, sf):
    docs = I.corpus(spark, sf)
    return R.sanitize_tables(docs, R.assign_placeholders(docs)).select(
        "doc_id", "sanitized_text", "redaction_count"
    )


# Two sessions write the same placeholders for a document; the later one counts.
@query(
    "build_vault",
    f"""
WITH {CORPUS}, {S.marks_cte("corpus")},
entries AS (
  SELECT doc_id, placeholder, original, category, 1000 AS added_at FROM marks
  UNION ALL SELECT doc_id, placeholder, upper(original), category, 1000 + (start % 3) - 1 FROM marks)
SELECT doc_id AS scope_id, placeholder, original, category, added_at::BIGINT AS added_at FROM entries
QUALIFY row_number() OVER (PARTITION BY doc_id, placeholder ORDER BY added_at DESC, original DESC) = 1""",
)
def build_vault(spark, sf):
    marks = R.assign_placeholders(I.corpus(spark, sf))
    both = marks.select(
        "doc_id",
        "placeholder",
        "category",
        F.inline(
            F.array(
                F.struct(F.col("original"), F.lit(1000).cast("long").alias("added_at")),
                F.struct(
                    F.upper("original").alias("original"),
                    (F.lit(1000) + F.col("start") % 3 - 1).cast("long").alias("added_at"),
                ),
            )
        ),
    )
    return V.build_vault(both)


@query("rehydrate", f"WITH {CORPUS} SELECT doc_id, text AS restored_text FROM corpus")
def rehydrate(spark, sf):
    # stored once: the vault and the texts come from the same run
    clean = write_through(spark, R.sanitize(I.corpus(spark, sf)).select("doc_id", "sanitized_text", "marks"), "clean")
    vault = V.build_vault(R.placeholder_rows(clean).withColumn("added_at", F.lit(0).cast("long")))
    return V.rehydrate(clean.select("doc_id", "sanitized_text"), vault).select("doc_id", "restored_text")


@query(
    "policy_report",
    f"""
WITH {CORPUS}, {S.marks_cte("corpus")}
SELECT 'vault' AS section, category AS name, placeholder, count(*) AS entries FROM marks GROUP BY ALL
UNION ALL SELECT 'policy', 'max_file_bytes', '5242880', 0
UNION ALL SELECT 'policy', 'allowed_roots', '/corpus', 0""",
)
def policy_report(spark, sf):
    vault = V.build_vault(R.assign_placeholders(I.corpus(spark, sf)).withColumn("added_at", F.lit(0).cast("long")))
    return V.policy_report(vault, {"max_file_bytes": "5242880", "allowed_roots": "/corpus"})


# Known values: every document's own first word and the first two letters of it, one
# value inside the other.
_FINDINGS_SQL = """
first_word AS (SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z]+'), '') AS value FROM documents),
findings AS (
  SELECT doc_id, value, 'NAME' AS type FROM first_word WHERE value IS NOT NULL
  UNION ALL SELECT doc_id, substring(value, 1, 2), 'PART' FROM first_word WHERE length(value) > 2),
chosen AS (
  SELECT doc_id, value, min(type) AS type FROM findings GROUP BY ALL),
pair AS (
  SELECT doc_id, first(value ORDER BY length(value) DESC, value) AS v1, first(type ORDER BY length(value) DESC, value) AS t1,
         last(value ORDER BY length(value) DESC, value) AS v2, last(type ORDER BY length(value) DESC, value) AS t2, count(*) AS n
  FROM chosen GROUP BY doc_id)"""


def _template_sql(kind: str, label: str) -> str:
    whens = " ".join(
        f"WHEN '{name}' THEN replace({S.quote(t)}, '{{t}}', {label})" for name, t in R.TEMPLATES.items()
    )
    return f"CASE {kind} {whens} ELSE replace('{R.DEFAULT_TEMPLATE}', '{{t}}', {label}) END"


def _file_type_sql(path: str) -> str:
    from veilspark.operators.files import FILE_TYPES

    ext = f"lower(regexp_extract({path}, '[^/.][^/]*(\\.[^/.]*)$', 1))"
    whens = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in FILE_TYPES.items())
    return f"CASE {ext} {whens} ELSE 'text' END"


@query(
    "redact_by_findings",
    f"""
WITH files AS ({I.FILES_SQL}), {_FINDINGS_SQL},
typed AS (SELECT f.doc_id, f.text, {_file_type_sql("f.path")} AS file_type, p.* EXCLUDE (doc_id)
          FROM files f LEFT JOIN pair p ON f.doc_id = p.doc_id),
cuts AS (SELECT *, CASE WHEN n IS NULL THEN [text] ELSE string_split(text, v1) END AS parts FROM typed),
inner_cuts AS (
  SELECT *, CASE WHEN n = 2 THEN list_transform(parts, lambda p: replace(p, v2, {_template_sql("file_type", "t2")})) ELSE parts END AS done,
         CASE WHEN n = 2 THEN list_sum(list_transform(parts, lambda p: len(string_split(p, v2)) - 1)) ELSE 0 END AS more FROM cuts)
SELECT doc_id, file_type, array_to_string(list_transform(done, lambda p, i: CASE WHEN i = 1 THEN p ELSE {_template_sql("file_type", "t1")} || p END), '') AS redacted_text,
       (len(parts) - 1 + more)::INT AS redaction_count
FROM inner_cuts""",
)
def redact_by_findings(spark, sf):
    files = I.files(spark, sf)
    first = files.select(
        "doc_id", F.nullif(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")).alias("value")
    )
    findings = (
        first.where(F.col("value").isNotNull())
        .select("doc_id", "value", F.lit("NAME").alias("type"))
        .unionByName(
            first.where(F.length("value") > 2).select(
                "doc_id", F.substring("value", 1, 2).alias("value"), F.lit("PART").alias("type")
            )
        )
    )
    return R.redact_by_findings(I.spread(files), findings).select(
        "doc_id", "file_type", "redacted_text", "redaction_count"
    )


# One list for all documents: the first run of sixteen digits of each.
_VALUES_SQL = f"""
WITH files AS ({I.FILES_SQL}),
known AS (SELECT coalesce(list(DISTINCT regexp_extract(text, '[0-9]{{16}}')), []) AS vals FROM files WHERE regexp_matches(text, '[0-9]{{16}}')),
cut AS (SELECT doc_id, {_file_type_sql("path")} AS file_type, regexp_extract_all(text, '[0-9]{{16}}') AS m, string_split_regex(text, '[0-9]{{16}}') AS g FROM files),
marked AS (SELECT *, list_transform(m, lambda x: list_contains(vals, x)) AS hit FROM cut, known)
SELECT doc_id, file_type, array_to_string(list_transform(g, lambda p, i: p || CASE WHEN i > len(m) THEN '' WHEN hit[i] THEN {_template_sql("file_type", "'CARD'")} ELSE m[i] END), '') AS redacted_text,
       len(list_filter(hit, lambda h: h))::INT AS redaction_count
FROM marked"""


@query("redact_known_values", _VALUES_SQL)
def redact_known_values(spark, sf):
    files = I.files(spark, sf)
    value = F.nullif(F.regexp_extract("text", "[0-9]{16}", 0), F.lit(""))
    known = files.select(value.alias("value"), F.lit("CARD").alias("type")).where("value IS NOT NULL")
    return redact_values(files, known).select("doc_id", "file_type", "redacted_text", "redaction_count")


# An edit log per conversation: two edits per turn, the last user turn ends it.
@query(
    "replay_edits",
    """
WITH RECURSIVE talk AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
raw AS (SELECT conv_id AS doc_id, turn + 1 AS turn, string_split(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' ') AS w,
               role = 'user' AND turn >= 4 AS done FROM conversations),
words AS (SELECT doc_id, turn, list_filter(w, lambda x: length(x) > 2) AS w, done FROM raw),
edits AS (
  SELECT doc_id, turn, 1 AS seq, w[1] AS o, '<' || turn || '>' AS n, false AS al, done FROM words WHERE len(w) > 0
  UNION ALL SELECT doc_id, turn, 2, w[2], '{' || turn || '}', true, done FROM words WHERE len(w) > 1),
stops AS (SELECT doc_id, min(turn) AS stop FROM edits WHERE done GROUP BY doc_id),
log AS (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY turn, seq) AS k
        FROM edits e LEFT JOIN stops s ON e.doc_id = s.doc_id WHERE stop IS NULL OR turn <= stop),
run AS (
  SELECT doc_id, 0::BIGINT AS k, text FROM talk
  UNION ALL
  SELECT r.doc_id, l.k, CASE WHEN l.al THEN replace(r.text, l.o, l.n) WHEN instr(r.text, l.o) = 0 THEN r.text
         ELSE substring(r.text, 1, instr(r.text, l.o) - 1) || l.n || substring(r.text, instr(r.text, l.o) + length(l.o)) END
  FROM run r JOIN log l ON r.doc_id = l.doc_id AND l.k = r.k + 1)
SELECT doc_id, last(text ORDER BY k) AS edited_text, max(k)::INT AS edit_count FROM run GROUP BY doc_id""",
)
def replay_edits(spark, sf):
    talk = I.table(spark, sf, "conversations")
    docs = talk.groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t.text), "\n"
        ).alias("text")
    )
    words = F.filter(
        F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " ", -1), lambda x: F.length(x) > 2
    )
    turn = (F.col("turn") + 1).alias("turn")
    shown = (F.col("turn") + 1).cast("string")
    done = ((F.col("role") == "user") & (F.col("turn") >= 4)).alias("done")
    edits = talk.select(
        F.col("conv_id").alias("doc_id"),
        turn,
        done,
        F.inline(
            F.array(
                F.struct(
                    F.lit(1).alias("seq"), F.get(words, F.lit(0)).alias("old_string"),
                    F.concat(F.lit("<"), shown, F.lit(">")).alias("new_string"), F.lit(False).alias("replace_all"),
                ),
                F.struct(
                    F.lit(2).alias("seq"), F.get(words, F.lit(1)).alias("old_string"),
                    F.concat(F.lit("{"), shown, F.lit("}")).alias("new_string"), F.lit(True).alias("replace_all"),
                ),
            )
        ),
    ).where(F.col("old_string").isNotNull())
    return R.replay_edits(docs, edits).select("doc_id", "edited_text", "edit_count")


# Model answers: fenced, bare, broken and empty ones in turn.
@query(
    "merge_model_findings",
    f"""
WITH {CORPUS}, {S.marks_cte("corpus")},
model AS (
  SELECT doc_id, 'NAME' AS category, 'Customer#' || lpad((doc_id - {I.RECORD_BASE})::VARCHAR, 9, '0') AS original,
         NULL::INT AS start, NULL::INT AS "end", '__NAME_1__' AS placeholder, 'model' AS origin
  FROM corpus WHERE source = 'crm' AND doc_id % 4 < 2)
SELECT *, CASE WHEN doc_id >= {I.RECORD_BASE} AND doc_id % 4 < 2 THEN 'llm+regex' ELSE 'regex-only' END AS method
FROM (SELECT doc_id, category, original, start, "end", placeholder, 'regex' AS origin FROM marks UNION ALL SELECT * FROM model)""",
)
def merge_model_findings(spark, sf):
    docs = I.corpus(spark, sf)
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("doc_id") - I.RECORD_BASE).cast("string"), 9, "0"))
    answer = F.to_json(
        F.struct(
            F.lit("x").alias("sanitized_text"),
            F.array(
                F.struct(F.lit("NAME").alias("type"), F.lit("__NAME_1__").alias("placeholder"), name.alias("context"))
            ).alias("redactions"),
        )
    )
    kind = F.col("doc_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```\n")))
        .when(kind == 1, answer)
        .when(kind == 2, F.expr("substring(to_json(struct('x' AS sanitized_text)), 1, 20)"))
        .otherwise(F.lit('{"sanitized_text": "", "redactions": []}'))
    )
    answers = docs.where(F.col("source") == "crm").select("doc_id", raw.alias("raw"))
    return R.merge_model_findings(docs, answers)


@query(
    "patch_lines",
    """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
ranges AS (
  SELECT doc_id, doc_id % 3 AS a, 1 + doc_id % 5 AS b FROM documents
  UNION ALL SELECT doc_id, 2 + doc_id % 4, 3 + doc_id % 11 FROM documents),
hit AS (SELECT l.*, EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = l.doc_id AND l.i BETWEEN r.a AND r.b) AS h FROM lines l)
SELECT doc_id, string_agg(CASE WHEN h THEN '[REDACTED by policy: review]' ELSE line END, chr(10) ORDER BY i) AS patched_text,
       count(CASE WHEN h THEN 1 END)::INT AS lines_redacted, first(text) AS backup_text
FROM hit GROUP BY doc_id""",
)
def patch_lines(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    d = F.col("doc_id")
    ranges = docs.select(
        "doc_id",
        F.inline(
            F.array(
                F.struct((d % 3).alias("start_line"), (d % 5 + 1).alias("end_line")),
                F.struct((d % 4 + 2).alias("start_line"), (d % 11 + 3).alias("end_line")),
            )
        ),
    )
    return R.patch_lines(I.spread(docs), ranges, "review").select(
        "doc_id", "patched_text", "lines_redacted", "backup_text"
    )


RUNS = f"runs AS ({I.RUNS_SQL.format(source=I.CORPUS_SQL)})"
_SPACE = S.quote(f"[{P.SPACE}]+")
TOKENS = f"""{RUNS},
numbered_runs AS (SELECT *, row_number() OVER (ORDER BY doc_id, page, run) AS run_id FROM runs),
run_pieces AS (
  SELECT *, string_split_regex(text, {_SPACE}) AS parts, regexp_extract_all(text, {_SPACE}) AS seps FROM numbered_runs),
pieces_at AS (
  SELECT run_id, doc_id, page, run, x, y, width / length(text) AS cw, height, unnest(parts) AS word, unnest(range(1, len(parts) + 1)) AS i,
         unnest(list_transform(range(1, len(parts) + 1), lambda k: coalesce(list_sum(list_transform(parts[1:k - 1], lambda p: length(p))), 0)
                + coalesce(list_sum(list_transform(seps[1:k - 1], lambda p: length(p))), 0)))::BIGINT AS "at"
  FROM run_pieces WHERE length(text) > 0),
words AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i) - 1 AS pos FROM pieces_at WHERE length(word) > 0),
tokens AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, run, pos) - 1 AS token_id, page, word AS text, run_id, "at",
         x + cw * (coalesce(sum(length(word) + 1) OVER (PARTITION BY run_id ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS x,
         y, length(word) * cw AS w, CASE WHEN coalesce(height, 0.0) = 0 THEN 12.0 ELSE height END::DOUBLE AS h
  FROM words)"""


def _tokens(spark, sf):
    return L.runs_to_tokens(I.runs(I.corpus(spark, sf)))


@query(
    "runs_to_tokens",
    f"WITH {TOKENS} SELECT doc_id, token_id, page, text, round(x, 4) AS x, round(y, 4)::DOUBLE AS y, round(w, 4)::DOUBLE AS w, h FROM tokens",
)
def runs_to_tokens(spark, sf):
    t = _tokens(spark, sf)
    return t.select(
        "doc_id", "token_id", "page", "text", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
        F.round("w", 4).alias("w"), "h",
    )


# Detections of each run, mapped to the words they overlap; the word "the" is known, and a model
# picks every document's first token.
FLAGGED = f"""{TOKENS}, run_text AS (SELECT run_id AS doc_id, text FROM numbered_runs), {S.detections_cte("run_text")},
seen AS (
  SELECT t.doc_id, t.token_id, first(d.category ORDER BY d.start, d."end" DESC, d.priority) AS category,
         first(d.value ORDER BY d.start, d."end" DESC, d.priority) AS value
  FROM tokens t JOIN detections d ON d.doc_id = t.run_id AND d.start < t."at" + length(t.text) AND d."end" > t."at" GROUP BY ALL),
flagged AS (
  SELECT t.*, s.category, s.value FROM tokens t LEFT JOIN seen s ON t.doc_id = s.doc_id AND t.token_id = s.token_id
  WHERE t.token_id = 0 OR t.text = 'the' OR s.category IS NOT NULL)"""


def _flagged(spark, sf):
    docs = I.corpus(spark, sf).select("doc_id")
    known = docs.withColumn("text", F.lit("the"))
    picked = docs.withColumn("token_id", F.lit(0).cast("long"))
    return L.flag_tokens(L.runs_to_tokens(I.runs(I.corpus(spark, sf)), P.DEFAULT_RULES), known, picked)


@query(
    "layout_vault",
    f"""
WITH {FLAGGED}, firsts AS (
  SELECT doc_id, category, value AS original, min(token_id) AS f FROM flagged WHERE category IS NOT NULL GROUP BY doc_id, category, value)
SELECT doc_id, category, original, '__' || category || '_' || row_number() OVER (PARTITION BY doc_id, category ORDER BY f, original) || '__' AS placeholder
FROM firsts""",
)
def layout_vault(spark, sf):
    return L.layout_vault(_flagged(spark, sf))


@query("flag_tokens", f"WITH {FLAGGED} SELECT doc_id, token_id, page, text, category, value FROM flagged")
def flag_tokens(spark, sf):
    return _flagged(spark, sf).select("doc_id", "token_id", "page", "text", "category", "value")


@query(
    "merge_rects",
    f"""
WITH {FLAGGED},
lined AS (SELECT *, (floor(y / 2 + 0.5) * 2)::INT AS line FROM flagged),
heads AS (
  SELECT *, CASE WHEN max(x + w) OVER o IS NULL OR x - max(x + w) OVER o > 10 THEN 1 ELSE 0 END AS head FROM lined
  WINDOW o AS (PARTITION BY doc_id, page, line ORDER BY x, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
isl AS (SELECT *, sum(head) OVER (PARTITION BY doc_id, page, line ORDER BY x, token_id ROWS UNBOUNDED PRECEDING) AS island FROM heads)
SELECT doc_id, page, round(min(x) - 1, 4) AS x, round(first(y ORDER BY x, token_id) - 1, 4)::DOUBLE AS y,
       round(max(x + w) - min(x) + 2, 4) AS w, round(max(h) + 2, 4) AS h, 'PII redacted' AS reason
FROM isl GROUP BY doc_id, page, line, island""",
)
def merge_rects(spark, sf):
    return L.merge_rects(_flagged(spark, sf)).select(
        "doc_id", "page", *[F.round(c, 4).alias(c) for c in ("x", "y", "w", "h")], "reason"
    )


SEARCH = r"[a-z]+ion\b.*@|\d{3}[-.]\d{3}|the "


@query(
    "search_sanitized",
    f"""
WITH files AS ({I.FILES_SQL}),
named AS (SELECT doc_id, regexp_replace(regexp_replace(path, '/tmp/\\.\\./', '/'), '/corpus/\\.\\./', '/') AS clean, path, text FROM files),
open_files AS (
  SELECT * FROM named WHERE starts_with(clean, '/corpus/') AND NOT regexp_matches(clean, '(/\\.env$|/\\.env\\.[^/]*$|\\.pem$|/\\.ssh/.+)')),
lines AS (SELECT path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line FROM open_files),
hits AS (SELECT *, (count(*) OVER (PARTITION BY path))::INT AS n FROM lines
         WHERE regexp_matches(text, {S.quote(P.sql_pattern(SEARCH))})),
top AS (SELECT *, row_number() OVER (ORDER BY path, line) AS doc_id FROM hits),
{S.sanitized_cte("top")}
SELECT t.path, t.line, trim(s.sanitized_text) AS snippet, t.n AS file_matches
FROM top t JOIN sanitized s ON t.doc_id = s.doc_id""",
)
def search(spark, sf):
    return search_sanitized(I.spread(I.files(spark, sf)), SEARCH, [I.ROOT])
