"""Named queries: evaluation and curation."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.operators import curate as C
from veilspark.operators import evaluate as E
from veilspark.operators import sketches as K
from veilspark.operators.verdict import LABELS
from veilspark.plans import inputs as I
from veilspark.plans import sql_text as S
from veilspark.plans.catalog import query
from veilspark.session import write_through

PRED = f"predictions AS ({I.PREDICTIONS_SQL})"
_LABEL_LIST = I._sql_list(LABELS)
LABEL_ROWS = f"label_rows AS (SELECT unnest({_LABEL_LIST}) AS label)"


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "confusion_matrix",
    f"""
WITH {PRED}, {LABEL_ROWS}
SELECT l.label AS expected, {", ".join(f"count(CASE WHEN p.predicted = '{x}' THEN 1 END) AS {x}" for x in LABELS)}
FROM label_rows l LEFT JOIN predictions p ON l.label = p.expected GROUP BY l.label""",
)
def confusion_matrix(spark, sf):
    return E.confusion_matrix(I.predictions(spark, sf))


REPORT = f"""{PRED}, {LABEL_ROWS},
counts AS (
  SELECT l.label, count(CASE WHEN p.expected = l.label AND p.predicted = l.label THEN 1 END) AS tp,
         count(CASE WHEN p.expected <> l.label AND p.predicted = l.label THEN 1 END) AS fp,
         count(CASE WHEN p.expected = l.label AND p.predicted <> l.label THEN 1 END) AS fn
  FROM label_rows l CROSS JOIN predictions p GROUP BY l.label),
pr AS (
  SELECT label, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall, tp + fn AS support FROM counts),
report AS (
  SELECT label, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM pr)"""


@query(
    "class_report",
    f"WITH {REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report",
)
def class_report(spark, sf):
    return rounded(E.class_report(I.predictions(spark, sf)), "precision", "recall", "f1")


@query(
    "overall_metrics",
    f"""
WITH {REPORT}, totals AS (SELECT count(*) AS n, count(CASE WHEN expected = predicted THEN 1 END) AS correct FROM predictions)
SELECT any_value(n) AS n, any_value(correct) AS correct, round(any_value(correct) / any_value(n)::DOUBLE, 6) AS accuracy,
       round(avg(f1), 6) AS macro_f1, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision,
       round(sum(recall * support) / sum(support), 6) AS weighted_recall
FROM report, totals""",
)
def overall_metrics(spark, sf):
    m = E.overall_metrics(I.predictions(spark, sf))
    return rounded(m, *[c for c in m.columns if c not in ("n", "correct")])


@query(
    "latency_percentiles",
    """
WITH firsts AS (SELECT event_type AS run, min(event_id) AS f, arg_min(value, event_id) AS cold_ms FROM events GROUP BY 1)
SELECT run, any_value(cold_ms) AS cold_ms, count(e.value) AS warm_calls, round(quantile_cont(e.value, 0.5), 6) AS p50,
       round(quantile_cont(e.value, 0.95), 6) AS p95, round(quantile_cont(e.value, 0.99), 6) AS p99
FROM firsts JOIN events e ON e.event_type = run AND e.event_id > f GROUP BY run""",
)
def latency_percentiles(spark, sf):
    calls = I.predictions(spark, sf).withColumnRenamed("case_id", "call_id")
    return rounded(E.latency_percentiles(calls, ["run"]), "p50", "p95", "p99")


# What sketches give exactly: number, least and greatest value of each day, from its hours.
@query(
    "latency_sketches",
    """
SELECT event_type AS run, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(value) AS n, min(value) AS min_ms, max(value) AS max_ms
FROM events WHERE value IS NOT NULL GROUP BY ALL""",
)
def latency_sketches(spark, sf):
    calls = I.table(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"))
    stored = write_through(spark, K.sketch_calls(calls, ["run"]), "sketches")
    days = stored.withColumn("day", F.date_format("span_start", "yyyy-MM-dd"))
    found = K.read_sketches(K.merge_sketches(days, ["run", "day"]), ["run", "day"], {})
    return found.select("run", "day", "n", F.col("min").alias("min_ms"), F.col("max").alias("max_ms"))


# Percentiles of all hours; how far they are off has no SQL form, tests hold their ranks against the values.
@query("latency_approximate")
def latency_approximate(spark, sf):
    calls = I.table(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"))
    merged = K.merge_sketches(K.sketch_calls(calls, ["run"]), ["run"])
    return K.read_sketches(merged, ["run"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(
    "latency_nearest_rank",
    """
WITH r AS (SELECT event_type AS run, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT run, n, round(median(value), 6) AS median, max(CASE WHEN rn = greatest(1, floor(0.95::DOUBLE * n)::BIGINT) THEN value END) AS p95, max(value) AS max_ms
FROM r GROUP BY run, n""",
)
def latency_nearest_rank(spark, sf):
    return rounded(E.latency_nearest_rank(I.predictions(spark, sf), ["run"]), "median")


_WILSON = """
(c / n::DOUBLE + 1.96 * 1.96 / (2 * n) {sign} 1.96 * sqrt(c / n::DOUBLE * (1 - c / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)"""


@query(
    "wilson_interval",
    f"""
WITH {PRED}, t AS (SELECT run, count(*) AS n, count(CASE WHEN expected = predicted THEN 1 END) AS c FROM predictions GROUP BY run)
SELECT run, n, c AS correct, round(c / n::DOUBLE, 6) AS accuracy, round({_WILSON.format(sign="-")}, 6) AS low, round({_WILSON.format(sign="+")}, 6) AS high FROM t""",
)
def wilson_interval(spark, sf):
    return rounded(E.wilson_interval(I.predictions(spark, sf), ["run"]), "accuracy", "low", "high")


_STRICT = "CASE {x} WHEN 'classify_safe' THEN 0 WHEN 'flag_pii' THEN 1 WHEN 'block_transfer' THEN 2 WHEN 'request_permission' THEN 2 END"


@query(
    "error_direction",
    f"""
WITH {PRED}
SELECT expected, predicted, CASE WHEN predicted = 'classify_safe' THEN 'fail_open'
       WHEN ({_STRICT.format(x="predicted")}) > ({_STRICT.format(x="expected")}) THEN 'over_restrict' ELSE 'cross' END AS direction, count(*) AS n
FROM predictions WHERE expected <> predicted GROUP BY ALL""",
)
def error_direction(spark, sf):
    return E.error_direction(I.predictions(spark, sf))


@query(
    "release_gate",
    f"""
WITH {PRED}, t AS (SELECT run, count(*) AS n, count(CASE WHEN expected = predicted THEN 1 END) AS c, min(case_id) AS f,
  count(CASE WHEN expected <> predicted AND predicted = 'classify_safe' THEN 1 END) AS fail_open FROM predictions GROUP BY run),
warm AS (SELECT p.run, latency_ms, row_number() OVER (PARTITION BY p.run ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY p.run) AS m
         FROM predictions p JOIN t ON p.run = t.run AND case_id > f),
mid AS (SELECT run, max(CASE WHEN rn = m // 2 + 1 THEN latency_ms END) AS p50 FROM warm GROUP BY run),
g AS (SELECT t.run, n, c AS correct, c / n::DOUBLE AS accuracy, {_WILSON.format(sign="-")} AS low, fail_open, p50 FROM t JOIN mid ON t.run = mid.run)
SELECT run, n, correct, round(accuracy, 6) AS accuracy, round(low, 6) AS low, fail_open, p50, accuracy >= 0.949 AS accuracy_ok, low >= 0.886 AS low_ok,
       fail_open = 0 AS fail_open_ok, p50 <= 400 AS latency_ok, accuracy >= 0.949 AND low >= 0.886 AND fail_open = 0 AND p50 <= 400 AS passed FROM g""",
)
def release_gate(spark, sf):
    return rounded(E.release_gate(I.predictions(spark, sf)), "accuracy", "low")


# The later run: other predictions for some cases, some cases new, some gone.
@query(
    "regression_diff",
    f"""
WITH {PRED},
old AS (SELECT case_id, expected = predicted AS was FROM predictions WHERE case_id % 11 <> 0),
new AS (SELECT case_id, expected = CASE WHEN case_id % 3 = 0 THEN expected WHEN case_id % 5 = 0 THEN 'classify_safe' ELSE predicted END AS now
        FROM predictions WHERE case_id % 13 <> 0)
SELECT coalesce(old.case_id, new.case_id) AS case_id, CASE WHEN now IS NULL THEN 'removed' WHEN was IS NULL THEN 'added'
  WHEN NOT was AND now THEN 'fixed' WHEN was AND NOT now THEN 'newly_broken' WHEN NOT was THEN 'still_broken' ELSE 'still_right' END AS status
FROM old FULL JOIN new ON old.case_id = new.case_id""",
)
def regression_diff(spark, sf):
    before = I.predictions(spark, sf)
    k = F.col("case_id")
    changed = F.when(k % 3 == 0, F.col("expected")).when(k % 5 == 0, "classify_safe").otherwise(F.col("predicted"))
    return E.regression_diff(before.where(k % 11 != 0), before.withColumn("predicted", changed).where(k % 13 != 0))


_CASES = f"""
labeled AS ({I.LABELED_SQL}),
cases AS (SELECT '/set/' || doc_id AS path, CASE WHEN n_chars % 97 = 0 THEN 'unknown' ELSE label END AS label FROM labeled),
files AS (SELECT '/set/' || doc_id AS path FROM documents WHERE lang <> 'es'),
other AS (SELECT '/set/' || doc_id AS path FROM documents WHERE source = 'src1'),
per_label AS (SELECT label, count(*) AS n FROM cases GROUP BY label),
v AS (SELECT sum(n)::BIGINT AS cases, coalesce(sum(CASE WHEN label = 'unknown' THEN n END), 0)::BIGINT AS invalid,
      count(CASE WHEN label <> 'unknown' THEN 1 END) AS classes,
      max(CASE WHEN label <> 'unknown' THEN n END) - min(CASE WHEN label <> 'unknown' THEN n END) AS spread FROM per_label),
o AS (SELECT count(DISTINCT path) FILTER (path NOT IN (SELECT path FROM files)) AS missing,
             count(DISTINCT path) FILTER (path IN (SELECT path FROM other)) AS overlap FROM cases),
r AS (SELECT count(*) AS lacking FROM documents WHERE source = 'src2' AND '/set/' || doc_id NOT IN (SELECT path FROM cases))"""


@query(
    "dataset_checks",
    f"""
WITH {_CASES}
SELECT 'enough_cases' AS "check", cases >= 90 AS passed, cases AS detail FROM v
UNION ALL SELECT 'labels_valid', invalid = 0, invalid FROM v
UNION ALL SELECT 'all_classes_present', classes = 4, classes FROM v
UNION ALL SELECT 'class_balance', spread <= 25, spread FROM v
UNION ALL SELECT 'files_exist', missing = 0, missing FROM o
UNION ALL SELECT 'no_overlap', overlap = 0, overlap FROM o
UNION ALL SELECT 'required_present', lacking = 0, lacking FROM r""",
)
def dataset_checks(spark, sf):
    path = F.concat(F.lit("/set/"), F.col("doc_id").cast("string")).alias("path")
    cases = I.labeled(spark, sf).select(
        path, F.when(F.col("n_chars") % 97 == 0, "unknown").otherwise(F.col("label")).alias("label")
    )
    docs = I.table(spark, sf, "documents")
    return E.dataset_checks(
        cases,
        docs.where(F.col("lang") != "es").select(path),
        docs.where(F.col("source") == "src1").select(path),
        docs.where(F.col("source") == "src2").select(path),
    )


# Generated texts: documents and records, with a scenario that some of them echo.
GENERATED = f"""
corpus AS ({I.CORPUS_SQL}),
generated AS (
  SELECT doc_id, ({_LABEL_LIST})[(doc_id % 4)::INT + 1] AS label, text || CASE WHEN source = 'crm' THEN repeat(' filler', 20) ELSE '' END AS text,
         CASE WHEN doc_id % 6 = 0 THEN lower(substring(text, 1, 80)) ELSE 'Write a file about ' || source END AS scenario FROM corpus)"""


def _generated(spark, sf):
    d = F.col("doc_id")
    return I.corpus(spark, sf).select(
        "doc_id",
        F.get(F.array(*[F.lit(x) for x in LABELS]), (d % 4).cast("int")).alias("label"),
        F.concat("text", F.when(F.col("source") == "crm", " filler" * 20).otherwise("")).alias("text"),
        F.when(d % 6 == 0, F.lower(F.substring("text", 1, 80)))
        .otherwise(F.concat(F.lit("Write a file about "), "source")).alias("scenario"),
    )


_VALIDATE = f"""CASE WHEN length(text) < 300 THEN 'too short (' || length(text) || ' < 300)'
  WHEN contains(lower(text), lower(scenario)) THEN 'echoes scenario instruction'
  WHEN label = 'flag_pii' AND NOT {S.any_rule_sql(P.PII_RULES)} THEN 'flag_pii output contains no detectable PII pattern'
  WHEN label = 'block_transfer' AND NOT {S.any_rule_sql(P.SECRET_RULES)} THEN 'block_transfer output contains no detectable secret pattern'
  ELSE '' END"""


@query(
    "validate_rows",
    f"WITH {GENERATED}, v AS (SELECT doc_id, label, {_VALIDATE} AS reason FROM generated) SELECT *, reason = '' AS ok FROM v",
)
def validate_rows(spark, sf):
    return C.validate_rows(_generated(spark, sf)).select("doc_id", "label", "reason", "ok")


_SIGNAL = f"""CASE WHEN length(text) < 200 THEN 'too short (' || length(text) || ' chars)'
  WHEN label = 'flag_pii' AND NOT regexp_matches(text, {S.quote(P.sql_pattern(P.SIGNAL_EMAIL, True))}) THEN 'no email-shaped tokens'
  WHEN label = 'block_transfer' AND NOT regexp_matches(text, {S.quote(P.sql_pattern(P.SIGNAL_SECRET, True))}) THEN 'no credential-shaped key=value lines'
  ELSE '' END"""


@query(
    "class_signal",
    f"WITH {GENERATED}, v AS (SELECT doc_id, label, {_SIGNAL} AS reason FROM generated) SELECT *, reason = '' AS ok FROM v",
)
def class_signal(spark, sf):
    return C.class_signal(_generated(spark, sf)).select("doc_id", "label", "reason", "ok")


def _live_sql():
    from veilspark.plans.text import _live_secret_sql

    return _live_secret_sql("generated")


@query(
    "collect_quota",
    f"""
WITH {GENERATED}, live AS (SELECT DISTINCT doc_id FROM ({_live_sql()})),
good AS (SELECT doc_id, label, doc_id % 5 AS query_rank, doc_id AS hit_rank FROM generated
         WHERE {_SIGNAL} = '' AND doc_id NOT IN (SELECT doc_id FROM live))
SELECT label, query_rank, hit_rank FROM good QUALIFY row_number() OVER (PARTITION BY label ORDER BY query_rank, hit_rank) <= 40""",
)
def collect_quota(spark, sf):
    candidates = _generated(spark, sf).select(
        "label", (F.col("doc_id") % 5).alias("query_rank"), F.col("doc_id").alias("hit_rank"), "text"
    )
    return C.collect_quota(candidates, 40).drop("text")


# Attempts: several generated texts per scenario, tried in turn; some calls failed.
@query(
    "first_valid_attempt",
    f"""
WITH {GENERATED},
attempts AS (SELECT 'scenario:' || (doc_id // 3) AS scenario_id, (doc_id % 3)::INT AS attempt, doc_id % 8 = 0 AS failed, * FROM generated),
checked AS (SELECT scenario_id, attempt, text, CASE WHEN failed THEN 'no response' ELSE {_VALIDATE} END AS reason FROM attempts),
best AS (SELECT scenario_id, min(CASE WHEN reason = '' THEN attempt END) AS attempt, arg_max(reason, attempt) AS last FROM checked GROUP BY 1)
SELECT b.scenario_id, b.attempt, coalesce(c.text, '') AS text, CASE WHEN b.attempt IS NOT NULL THEN 'ok' ELSE b.last END AS status
FROM best b LEFT JOIN checked c ON b.scenario_id = c.scenario_id AND b.attempt = c.attempt""",
)
def first_valid_attempt(spark, sf):
    d = F.col("doc_id")
    attempts = _generated(spark, sf).select(
        F.concat(F.lit("scenario:"), F.floor(d / 3).cast("string")).alias("scenario_id"),
        (d % 3).cast("int").alias("attempt"),
        "label",
        F.when(d % 8 != 0, F.col("text")).alias("text"),
        "scenario",
    )
    return C.first_valid_attempt(attempts)


@query(
    "content_dedupe",
    "SELECT sha1(text) AS content_hash, substr(sha1(text), 1, 24) AS name, min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY sha1(text)",
)
def content_dedupe(spark, sf):
    return C.content_dedupe(I.table(spark, sf, "documents"))


@query(
    "content_overlap",
    "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'fr' OR source = 'src3') AND text NOT IN (SELECT text FROM benchmark)",
)
def content_overlap(spark, sf):
    docs = I.table(spark, sf, "documents")
    seen = docs.where((F.col("lang") == "fr") | (F.col("source") == "src3")).select("text")
    return C.without_overlap(docs, seen.unionByName(I.table(spark, sf, "benchmark").select("text"))).select("doc_id")


@query(
    "cap_per_class",
    f"WITH labeled AS ({I.LABELED_SQL}) SELECT doc_id, label FROM labeled QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) <= 50",
)
def cap_per_class(spark, sf):
    return C.cap_per_class(I.labeled(spark, sf).select("doc_id", "label"), 50, ["doc_id"])


FOLDS_SQL = """
SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) - 1) % 5)::INT AS fold FROM embeddings"""


@query("stratified_folds", FOLDS_SQL)
def stratified_folds(spark, sf):
    return C.stratified_folds(I.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")


# Per-fold scores of a prompt x C grid, from events.
SWEEP = """
folds AS (
  SELECT event_type AS prompt, ([0.1, 1.0, 10.0])[(user_id % 3)::INT + 1]::DOUBLE AS C, event_id % 5 AS fold,
         avg(value / (value + 10)) AS f1, avg(value / (value + 5)) AS acc FROM events GROUP BY ALL),
sweep AS (SELECT prompt, C, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1, avg(acc) AS mean_acc, stddev_pop(acc) AS std_acc FROM folds GROUP BY ALL)"""
SWEEP_ROUND = "round(mean_f1, 6) AS mean_f1, round(std_f1, 6) AS std_f1, round(mean_acc, 6) AS mean_acc, round(std_acc, 6) AS std_acc"


def _sweep(spark, sf):
    c = F.get(F.array(F.lit(0.1), F.lit(1.0), F.lit(10.0)), (F.col("user_id") % 3).cast("int"))
    v = F.col("value")
    folds = (
        I.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("prompt"), c.alias("C"), (F.col("event_id") % 5).alias("fold"))
        .agg(F.avg(v / (v + 10)).alias("f1"), F.avg(v / (v + 5)).alias("acc"))
    )
    return E.sweep_summary(folds)


@query("sweep_summary", f"WITH {SWEEP} SELECT prompt, C, {SWEEP_ROUND} FROM sweep")
def sweep_summary(spark, sf):
    return rounded(_sweep(spark, sf), "mean_f1", "std_f1", "mean_acc", "std_acc")


@query(
    "select_winner",
    f"""
WITH {SWEEP}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY mean_f1 DESC, prompt, C)::INT AS rank, max(mean_f1) OVER () AS top FROM sweep)
SELECT prompt, C, {SWEEP_ROUND}, rank, mean_f1 >= top - 0.005 AND rank > 1 AS near_tie FROM ranked""",
)
def select_winner(spark, sf):
    return rounded(E.select_winner(_sweep(spark, sf)), "mean_f1", "std_f1", "mean_acc", "std_acc")


@query(
    "cv_results_by_C",
    f"""
WITH {SWEEP}
SELECT prompt, C, round(mean_f1, 6) AS macro_f1_mean, round(std_f1, 6) AS macro_f1_std, round(mean_acc, 6) AS accuracy_mean,
       round(std_acc, 6) AS accuracy_std, NULL::VARCHAR AS note FROM sweep WHERE prompt = 'view'
UNION ALL SELECT 'never_swept', 1.0, NULL, NULL, NULL, NULL, 'no sweep results available; metrics not recorded'""",
)
def cv_results_by_c(spark, sf):
    sweep = _sweep(spark, sf)
    both = E.cv_results_by_c(sweep, "view", 1.0).unionByName(E.cv_results_by_c(sweep, "never_swept", 1.0))
    rows = both.select("prompt", F.explode("cv_results").alias("C", "m")).select("prompt", "C", "m.*")
    return rounded(rows, "macro_f1_mean", "macro_f1_std", "accuracy_mean", "accuracy_std")
