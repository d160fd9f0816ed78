"""Named queries: sources, admission, policy, cache, verdicts, routing, audit."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import patterns as P
from veilspark.functions.globs import normal_path
from veilspark.functions.spans import find_spans
from veilspark.operators import audit as A
from veilspark.operators import curate as C
from veilspark.operators import files as X
from veilspark.operators import incremental as N
from veilspark.operators import path_rules
from veilspark.operators import policy as Y
from veilspark.operators import redact as R
from veilspark.operators import verdict as V
from veilspark.operators.search import search_sanitized
from veilspark.plans import inputs as I
from veilspark.plans import sql_text as S
from veilspark.plans.catalog import ORACLES, QUERIES, query
from veilspark.plans.text import CORPUS, SEARCH, _file_type_sql
from veilspark.session import scratch_path
from veilspark.sources import corpus as K
from veilspark.sources.store import ArtifactStore

FILES = f"files AS ({I.FILES_SQL})"
_EXT = "lower(regexp_extract(path, '[^/.][^/]*(\\.[^/.]*)$', 1))"
_IMAGES = "(" + ", ".join(f"'{e}'" for e in X.IMAGE_EXTENSIONS) + ")"
_FORMAT = f"CASE WHEN {_EXT} IN {_IMAGES} THEN 'binary' WHEN {_EXT} = '.pdf' THEN 'pdf' WHEN {_EXT} IN ('.docx', '.doc') THEN 'docx' ELSE 'text' END"


LIMIT = 5 * 1024 * 1024


def _image_sql(path_ext: str = _EXT) -> str:
    return f"""CASE WHEN {path_ext} IN {_IMAGES} THEN 'Image file (' || {path_ext} || '); OCR not supported in v1. Routing to request_permission for human review.' END"""


def _gate_sql(path_ext: str = _EXT) -> str:
    return f"""CASE WHEN size_bytes > {LIMIT} THEN 'File size ' || size_bytes || ' exceeds {LIMIT}-byte limit; routing to request_permission for explicit human review.'
     WHEN {path_ext} IN {_IMAGES} THEN 'Image file (' || {path_ext} || '); OCR not supported in v1. Routing to request_permission for human review.' END"""


@query(
    "load_corpus",
    """
SELECT 'bucket=' || (doc_id % 40) AS folder, 'text' AS format, md5(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS digest,
       (sum(strlen(text) + 1))::BIGINT AS size_bytes, true AS recent
FROM documents GROUP BY doc_id % 40""",
)
def load_corpus(spark, sf):
    """Documents written as forty files, a line break after each, then read back file by file."""
    docs = I.table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("bucket"))
    root = scratch_path(spark, "corpus")
    one_file_each = docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    one_file_each.drop("doc_id").write.partitionBy("bucket").text(root)
    return K.load_corpus(spark, root, "*.txt").select(
        F.regexp_extract("path", "/(bucket=[0-9]+)/", 1).alias("folder"), "format", F.md5("text").alias("digest"), "size_bytes",
        F.col("mtime").between(F.unix_millis(F.current_timestamp()) - 86_400_000, F.unix_millis(F.current_timestamp()) + 60_000).alias("recent"))


@query(
    "format_inventory",
    f"WITH {FILES} SELECT {_FORMAT} AS format, {_file_type_sql('path')} AS file_type, count(*) AS n_files FROM files GROUP BY ALL",
)
def format_inventory(spark, sf):
    return X.format_inventory(I.files(spark, sf))


@query(
    "admission_gate",
    f"""WITH {FILES} SELECT path, size_bytes, {_FORMAT} AS format, ({_gate_sql()}) IS NOT NULL AS escalate, {_gate_sql()} AS escalate_reason FROM files""",
)
def admission_gate(spark, sf):
    return X.admission_gate(I.files(spark, sf), max_bytes=LIMIT).select(
        "path", "size_bytes", "format", "escalate", "escalate_reason"
    )


# Holdout files: a label folder per labelled document (one folder is no label), sidecars,
# README files, and a manifest that also names files that do not exist.
HOLDOUT = f"""
labeled AS ({I.LABELED_SQL}),
holdout AS (
  SELECT doc_id, label, CASE WHEN doc_id % 9 = 0 THEN '/holdout/misc/' ELSE '/holdout/' || label || '/' END || CASE doc_id % 10
    WHEN 0 THEN doc_id || '.txt.provenance.json' WHEN 1 THEN 'README.md' ELSE doc_id || '.txt' END AS path FROM labeled),
loose AS (SELECT doc_id, '/loose/' || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'flag_pii' ELSE 'classify_safe' END AS label FROM documents)"""


@query(
    "labeled_manifest",
    f"""
WITH {HOLDOUT}
SELECT path, regexp_extract(path, '^/holdout/([^/]+)/', 1) AS label FROM holdout
WHERE path NOT LIKE '/holdout/misc/%' AND path NOT LIKE '%.provenance.json' AND path NOT LIKE '%/README.md'
UNION ALL SELECT path, label FROM loose WHERE doc_id % 3 <> 0""",
)
def labeled_manifest(spark, sf):
    d = F.col("doc_id")
    name = (
        F.when(d % 10 == 0, F.concat(d.cast("string"), F.lit(".txt.provenance.json")))
        .when(d % 10 == 1, "README.md")
        .otherwise(F.concat(d.cast("string"), F.lit(".txt")))
    )
    folder = F.when(d % 9 == 0, "/holdout/misc/").otherwise(F.concat(F.lit("/holdout/"), "label", F.lit("/")))
    holdout = I.labeled(spark, sf).select(F.concat(folder, name).alias("path"))
    loose = I.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("/loose/"), d.cast("string"), F.lit(".md")).alias("path"),
        F.when(d % 2 == 0, "flag_pii").otherwise("classify_safe").alias("label"),
    )
    present = holdout.unionByName(loose.where(d % 3 != 0).select("path"))
    return C.labeled_manifest(present, loose, "/holdout")


_MINED = """CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 5 = 0 THEN 'flag_pii' WHEN d.doc_id % 7 = 0 THEN NULL ELSE 'block_transfer' END"""


@query(
    "provenance_join",
    f"""
SELECT 'mined:' || d.source || ':' || d.doc_id AS scenario_id, '/mined/' || d.source || '/' || d.doc_id || '.txt' AS path,
       {_MINED} AS label, d.text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE {_MINED} IS NOT NULL""",
)
def provenance_join(spark, sf):
    docs = I.table(spark, sf, "documents")
    marks = I.table(spark, sf, "labels").select("doc_id")
    path = F.concat(F.lit("/mined/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    contents = docs.select(path.alias("path"), "text")
    by_hand, none = F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0
    about = F.to_json(
        F.struct(
            F.when(~none, "block_transfer").alias("label"),
            F.when(by_hand, "flag_pii").alias("hand_assigned_label"),
            F.col("source").alias("source_repo"),
            F.col("n_chars").cast("int").alias("length_chars"),
            F.array(F.lit("API_KEY"), F.lit("SECRET")).alias("collector_query_terms"),
        )
    )
    sidecars = docs.join(marks, "doc_id", "left_semi").select(
        F.concat(path, F.lit(".provenance.json")).alias("path"), about.alias("text")
    )
    return C.provenance_join(contents.unionByName(sidecars))


@query(
    "read_jsonl",
    """
SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 3""",
)
def read_jsonl(spark, sf):
    """Events as JSON lines, with broken and blank lines between them."""
    events = I.table(spark, sf, "events")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    broken = F.col("event_id") % 10 == 3
    lines = events.select(F.when(broken, F.substring(line, 1, 12)).otherwise(line).alias("value")).unionByName(
        events.where(F.col("event_id") % 7 == 0).select(F.lit("  ").alias("value"))
    )
    path = scratch_path(spark, "jsonl")
    lines.write.text(path)
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    return K.read_jsonl(spark, path, schema)


TRAINING = f"""
labeled AS ({I.LABELED_SQL}),
training AS (
  SELECT label || ':' || (row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1) AS scenario_id, label, text FROM labeled
  UNION ALL SELECT 'mined:bench:' || item_id, 'classify_safe', text FROM benchmark)"""


def _training(spark, sf):
    curated = I.labeled(spark, sf)
    mined = I.table(spark, sf, "benchmark").select(
        F.concat(F.lit("mined:bench:"), F.col("item_id").cast("string")).alias("scenario_id"),
        F.lit("classify_safe").alias("label"),
        "text",
    )
    return C.build_training_set(curated, mined)


@query("build_training_set", f"WITH {TRAINING} SELECT scenario_id, label, text FROM training")
def build_training_set(spark, sf):
    return _training(spark, sf)


@query("training_class_counts", f"WITH {TRAINING} SELECT label, count(*) AS n FROM training GROUP BY label")
def training_class_counts(spark, sf):
    return C.class_counts(_training(spark, sf))


@query(
    "resume_pending",
    f"""
WITH {TRAINING}, done AS (SELECT scenario_id FROM training WHERE length(text) % 2 = 0)
SELECT scenario_id, label FROM training WHERE scenario_id NOT IN (SELECT scenario_id FROM done)""",
)
def resume_pending(spark, sf):
    training = _training(spark, sf)
    return C.resume_pending(training.select("scenario_id", "label"), training.where(F.length("text") % 2 == 0))


@query(
    "write_artifacts",
    f"""
WITH {FILES}, {S.sanitized_cte("files")}, keyed AS (
  SELECT sha256(path || '|' || mtime || '|' || size_bytes) AS k, sanitized_text FROM files JOIN sanitized ON files.doc_id = sanitized.doc_id)
SELECT substr(k, 1, 2) AS shard, count(*) AS n, sum(('0x' || substr(md5(k || sanitized_text), 1, 12))::BIGINT)::VARCHAR AS digest FROM keyed GROUP BY ALL""",
)
def write_artifacts(spark, sf):
    files = N.with_cache_key(I.spread(I.files(spark, sf)))
    made = R.sanitize(files).select("cache_key", "path", "sanitized_text", "redaction_count", "method")
    path = scratch_path(spark, "artifacts")
    K.write_artifacts(made, path)
    schema = T.StructType([*made.schema.fields, T.StructField("shard", T.StringType())])
    # a sum of hashes, which does not depend on the order and is built before the shuffle
    one = F.conv(F.substring(F.md5(F.concat("cache_key", "sanitized_text")), 1, 12), 16, 10).cast("decimal(20,0)")
    return spark.read.schema(schema).parquet(path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum(one).cast("string").alias("digest"))


@query(
    "write_audit",
    "SELECT event_type AS event, 'read' AS action, count(*) AS n, sum(event_id % 5)::BIGINT AS redactions FROM events GROUP BY ALL",
)
def write_audit(spark, sf):
    events = I.table(spark, sf, "events").select(
        F.col("event_type").alias("event"),
        F.lit("read").alias("action"),
        F.lit("1970-01-01").cast("timestamp").alias("timestamp"),
        (F.col("event_id") % 5).cast("int").alias("redaction_count"),
    )
    path = scratch_path(spark, "audit")
    K.write_audit(events, path)
    log = K.read_audit(spark, path)
    stamped = F.col("timestamp") > F.lit("2000-01-01").cast("timestamp")
    return log.where(stamped).groupBy("event", "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("redaction_count").alias("redactions")
    )


# --- policy -------------------------------------------------------------------------

_CLEAN = "regexp_replace(regexp_replace(path, '/tmp/\\.\\./', '/'), '/corpus/\\.\\./', '/')"


def _policy_sql(path: str) -> str:
    from veilspark.functions.globs import glob_regex

    def test(glob):
        return f"regexp_matches({path}, {S.quote(glob_regex(glob))})"

    whens = [f"WHEN {test(g)} THEN {S.quote(Y.REASON_DENY.format(g))}" for g in Y.DENY_GLOBS]
    whens.append(f"WHEN NOT ({path} = '{I.ROOT}' OR starts_with({path}, '{I.ROOT}/')) THEN '{Y.REASON_ROOT}'")
    whens += [f"WHEN {test(g)} THEN {S.quote(Y.REASON_ALWAYS.format(g))}" for g in Y.SANITIZE_GLOBS]
    return f"CASE {' '.join(whens)} ELSE '{Y.REASON_DEFAULT}' END"


_DENIED = f"(path_reason LIKE 'Path matches deny glob%' OR path_reason = '{Y.REASON_ROOT}')"


_PATH_POLICY_SQL = f"""
WITH {FILES}, cleaned AS (SELECT path, {_CLEAN} AS clean FROM files),
judged AS (SELECT path, {_policy_sql("clean")} AS path_reason FROM cleaned)
SELECT path, path_reason, CASE WHEN {_DENIED} THEN 'deny' ELSE 'sanitize' END AS path_verdict FROM judged"""


@query("path_policy", _PATH_POLICY_SQL)
def path_policy(spark, sf):
    return Y.path_policy(I.files(spark, sf).select("path"), [I.ROOT])


# The same policy as a table, with a rule for every hundredth file that comes after the others in rank.
_RULE_TABLE_SQL = f"""
WITH {FILES}, cleaned AS (SELECT doc_id, path, {_CLEAN} AS clean FROM files),
judged AS (SELECT doc_id, path, {_policy_sql("clean")} AS reason FROM cleaned),
ruled AS (SELECT j.path, CASE WHEN reason LIKE 'Path matches deny glob%' OR t.clean IS NULL THEN reason ELSE 'Path matches deny glob: ' || t.clean END AS path_reason
  FROM judged j LEFT JOIN (SELECT path, clean FROM cleaned WHERE doc_id % 100 = 7) t ON j.path = t.path)
SELECT path, path_reason, CASE WHEN {_DENIED} THEN 'deny' ELSE 'sanitize' END AS path_verdict FROM ruled"""


@query("path_policy_rules", _RULE_TABLE_SQL)
def path_policy_rules(spark, sf):
    files = I.files(spark, sf).select("doc_id", "path")
    own = files.where("doc_id % 100 = 7").select(F.lit(1000).cast("long").alias("rank"), F.lit("deny").alias("kind"), normal_path(F.col("path")).alias("glob"))
    rules = path_rules.rule_table(spark, [I.ROOT], Y.DENY_GLOBS, Y.SANITIZE_GLOBS).unionByName(own)
    return path_rules.path_policy_by_rules(files.select("path"), rules)


# Messages: some carry a placeholder, a key, a key too short to count, or both.
MESSAGES = """
messages AS (
  SELECT conv_id, turn, role, text || CASE (conv_id + turn) % 7 WHEN 0 THEN ' __EMAIL_1__' WHEN 1 THEN ' sk-' || repeat('a1', 6)
    WHEN 2 THEN ' __SECRET_2__ AKIA' || repeat('Z', 16) WHEN 3 THEN ' sk-short' WHEN 4 THEN ' xAKIA' || repeat('Z', 16) ELSE '' END AS payload
  FROM conversations)"""


def _messages(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 7
    extra = (
        F.when(kind == 0, " __EMAIL_1__").when(kind == 1, " sk-" + "a1" * 6)
        .when(kind == 2, " __SECRET_2__ AKIA" + "Z" * 16).when(kind == 3, " sk-short")
        .when(kind == 4, " xAKIA" + "Z" * 16).otherwise("")
    )
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.concat("text", extra).alias("payload")
    )


def _egress_sql(payload: str) -> str:
    return f"""CASE WHEN regexp_matches({payload}, {S.quote(P.sql_pattern(P.PLACEHOLDER))}) THEN '{P.EGRESS_PLACEHOLDER_REASON}'
 WHEN regexp_matches({payload}, {S.quote(P.sql_pattern(P.EGRESS_SECRET))}) THEN '{P.EGRESS_SECRET_REASON}' END"""


EGRESS_SQL = f"""
WITH {MESSAGES}, judged AS (SELECT conv_id, turn, {_egress_sql("payload")} AS reason FROM messages)
SELECT * FROM judged WHERE reason IS NOT NULL"""


@query("egress_scan", EGRESS_SQL)
def egress_scan(spark, sf):
    return Y.egress_scan(_messages(spark, sf)).select("conv_id", "turn", "reason")


_TOOLS = ["Read", "fs.glob", "HTTP", "curl", "Bash", "calculator", "message"]


@query(
    "tool_gate",
    f"""
WITH calls AS (
  SELECT event_id, ({I._sql_list(_TOOLS)})[(user_id % {len(_TOOLS)})::INT + 1] AS tool_name,
         to_json({{'user': user_id, 'payload': props || CASE event_id % 5 WHEN 0 THEN ' __SSN_3__' WHEN 1 THEN ' ghp_' || repeat('Ab', 10) ELSE '' END}})::VARCHAR AS params
  FROM events),
judged AS (
  SELECT event_id, tool_name, lower(tool_name) IN ({", ".join(f"'{t}'" for t in Y.READ_TOOLS)}) AS reads,
         CASE WHEN lower(tool_name) IN ({", ".join(f"'{t}'" for t in Y.EGRESS_TOOLS)}) THEN {_egress_sql("params")} END AS leak FROM calls)
SELECT event_id, tool_name, CASE WHEN reads THEN 'block' WHEN leak IS NOT NULL THEN 'egress_blocked' ELSE 'allow' END AS action,
       CASE WHEN reads THEN {S.quote(Y.READ_REASON)} ELSE leak END AS reason FROM judged""",
)
def tool_gate(spark, sf):
    extra = F.when(F.col("event_id") % 5 == 0, " __SSN_3__").when(
        F.col("event_id") % 5 == 1, " ghp_" + "Ab" * 10
    ).otherwise("")
    tools = F.array(*[F.lit(t) for t in _TOOLS])
    calls = I.table(spark, sf, "events").select(
        "event_id",
        F.get(tools, (F.col("user_id") % len(_TOOLS)).cast("int")).alias("tool_name"),
        F.struct(F.col("user_id").alias("user"), F.concat("props", extra).alias("payload")).alias("params"),
    )
    return Y.tool_gate(calls).drop("params")


# A patch of the first two lines of every file that policy allows.
@query(
    "tool_audit",
    f"""
WITH {FILES}, cleaned AS (SELECT *, {_CLEAN} AS clean FROM files), judged AS (SELECT *, {_policy_sql("clean")} AS path_reason FROM cleaned),
hits AS (
  SELECT path, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {S.quote(P.sql_pattern(SEARCH))}))) AS n FROM judged WHERE NOT {_DENIED}),
rows AS (
  SELECT 'patch' AS event, 'deny_path' AS action, path_reason AS reason, 0 AS c FROM judged WHERE {_DENIED}
  UNION ALL SELECT 'patch', 'patch', NULL, least(2, len(string_split(text, chr(10)))) FROM judged WHERE NOT {_DENIED}
  UNION ALL SELECT 'search', 'deny_path', path_reason, NULL FROM judged WHERE {_DENIED}
  UNION ALL SELECT 'search', 'search', NULL, n FROM hits WHERE n > 0)
SELECT event, action, reason, count(*) AS n, sum(c)::BIGINT AS redactions FROM rows GROUP BY ALL""",
)
def tool_audit(spark, sf):
    files = I.spread(I.files(spark, sf))
    ranges = files.select("doc_id", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    patched = R.patch_lines(files.select("doc_id", "path", "text"), ranges, "review", roots=[I.ROOT])
    rows = A.patch_audit(patched).unionByName(A.search_audit(files, search_sanitized(files, SEARCH, [I.ROOT]), [I.ROOT]))
    return rows.groupBy("event", "action", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("redaction_count").alias("redactions"))


@query(
    "gate_audit",
    "SELECT 'tool_call' AS event, action, reason, count(*) AS n FROM (" + ORACLES["tool_gate"] + ") WHERE action <> 'allow' GROUP BY ALL",
)
def gate_audit(spark, sf):
    gated = A.gate_audit(QUERIES["tool_gate"](spark, sf))
    return gated.groupBy("event", "action", "reason").agg(F.count(F.lit(1)).alias("n"))


# --- cache ------------------------------------------------------------------------------

# The earlier snapshot: the same files, some since touched, some made by older rules.
_KEY = "sha256(path || '|' || mtime || '|' || size_bytes)"
_OLD_MTIME = "CASE WHEN doc_id % 10 = 0 THEN mtime - 5000 ELSE mtime END"
SNAPSHOT = f"""
snapshot AS (
  SELECT doc_id, path, sha256(path || '|' || ({_OLD_MTIME}) || '|' || size_bytes) AS cache_key,
         CASE WHEN doc_id % 13 = 0 THEN 'default-0' ELSE 'default-1' END AS ruleset_version,
         'old ' || doc_id AS sanitized_text, (doc_id % 6)::INT AS redaction_count, 'regex-only' AS method,
         1000 + doc_id AS cached_at
  FROM files WHERE lang <> 'de')"""


def _snapshot(files, keep=()):
    mtime = F.when(F.col("doc_id") % 10 == 0, F.col("mtime") - 5000).otherwise(F.col("mtime"))
    old = files.where(F.col("lang") != "de").withColumn("mtime", mtime)
    return N.with_cache_key(old).select(
        *keep, "cache_key", "path", "mtime", "size_bytes",
        F.when(F.col("doc_id") % 13 == 0, "default-0").otherwise("default-1").alias("ruleset_version"),
        F.concat(F.lit("old "), F.col("doc_id").cast("string")).alias("sanitized_text"),
        (F.col("doc_id") % 6).cast("int").alias("redaction_count"),
        F.lit("regex-only").alias("method"),
        (F.lit(1000) + F.col("doc_id")).alias("cached_at"),
    )


@query(
    "cache_split",
    f"""
WITH {FILES}, {SNAPSHOT}
SELECT doc_id, {_KEY} AS cache_key,
       {_KEY} IN (SELECT cache_key FROM snapshot WHERE ruleset_version = 'default-1') AS hit FROM files""",
)
def cache_split(spark, sf):
    files = I.files(spark, sf).drop("text")
    return N.mark_hits(files, _snapshot(files)).select("doc_id", "cache_key", "hit")


def _upsert_sql(force: bool) -> str:
    order = "fresh DESC, cached_at DESC" if force else "cached_at DESC, fresh DESC"
    return f"""
WITH {FILES}, {SNAPSHOT},
fresh AS (
  SELECT {_KEY} AS cache_key, path, 'default-1' AS ruleset_version, 'new ' || doc_id AS sanitized_text,
         CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 5000000 END AS cached_at FROM files WHERE doc_id % 2 = 0)
SELECT cache_key, path, ruleset_version, sanitized_text, cached_at FROM (
  SELECT cache_key, path, ruleset_version, sanitized_text, cached_at, 0 AS fresh FROM snapshot
  UNION ALL SELECT *, 1 FROM fresh)
QUALIFY row_number() OVER (PARTITION BY cache_key, ruleset_version ORDER BY {order}) = 1"""


def _upsert(spark, sf, force):
    files = I.files(spark, sf).drop("text")
    columns = ["cache_key", "path", "ruleset_version", "sanitized_text", "cached_at"]
    fresh = N.with_cache_key(files.where(F.col("doc_id") % 2 == 0)).select(
        "cache_key", "path",
        F.lit("default-1").alias("ruleset_version"),
        F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("sanitized_text"),
        F.when(F.col("doc_id") % 4 == 0, 0).otherwise(5000000).cast("long").alias("cached_at"),
    )
    store = ArtifactStore(spark, scratch_path(spark, "store"))
    store.create(_snapshot(files).select(*columns))
    return store.read(store.upsert(fresh, force))


@query("cache_upsert", _upsert_sql(False))
def cache_upsert(spark, sf):
    return _upsert(spark, sf, False)


@query("cache_refresh", _upsert_sql(True))
def cache_refresh(spark, sf):
    return _upsert(spark, sf, True)


# The files of a run: documents, customer records, and one confidential memo per nation.
RUN_FILES = f"""
documents_as_files AS ({I.FILES_SQL}),
records AS ({I.RECORDS_SQL}),
files AS (
  SELECT doc_id, path, mtime, size_bytes, text, lang FROM documents_as_files
  UNION ALL SELECT doc_id, '/corpus/crm/' || doc_id || '.txt', 1700000000000 + doc_id, length(text), text, lang FROM records
  UNION ALL SELECT 2000000000 + n_nationkey, '/corpus/memo/' || n_nationkey || '.md', 1700000000000, 100, 'Strictly confidential: plans for ' || n_name, 'en' FROM nation)"""


def run_files(spark, sf):
    columns = ["doc_id", "path", "mtime", "size_bytes", "text", "lang"]
    own = I.spread(I.files(spark, sf)).select(*columns)
    record, d = I.records(spark, sf), F.col("doc_id")
    crm = record.select(
        "doc_id", F.concat(F.lit("/corpus/crm/"), d.cast("string"), F.lit(".txt")).alias("path"),
        (F.lit(1700000000000) + d).alias("mtime"), F.length("text").cast("long").alias("size_bytes"), "text", "lang")
    n = F.col("n_nationkey").cast("long")
    memos = I.table(spark, sf, "nation").select(
        (F.lit(2000000000) + n).alias("doc_id"), F.concat(F.lit("/corpus/memo/"), n.cast("string"), F.lit(".md")).alias("path"),
        F.lit(1700000000000).alias("mtime"), F.lit(100).cast("long").alias("size_bytes"),
        F.concat(F.lit("Strictly confidential: plans for "), "n_name").alias("text"), F.lit("en").alias("lang"))
    return own.unionByName(crm).unionByName(memos)


# What the earlier run said of some of them.
RUN_SNAPSHOT = f"""
{SNAPSHOT},
judged_before AS (
  SELECT cache_key, sanitized_text, redaction_count, (doc_id % 4) / 4.0::DOUBLE AS confidence,
         CASE doc_id % 5 WHEN 0 THEN 'safe' WHEN 1 THEN 'block' WHEN 2 THEN 'escalate' ELSE 'flag_pii' END AS verdict,
         CASE WHEN doc_id % 5 <> 0 THEN 'before: ' || doc_id END AS reason
  FROM snapshot WHERE ruleset_version = 'default-1' AND doc_id < 1500000000)"""


def _run_snapshot(files):
    k, d = F.col("doc_id") % 5, F.col("doc_id")
    old = _snapshot(files, keep=["doc_id"]).where("doc_id < 1500000000")
    return old.select(
        "*", ((d % 4) / 4.0).alias("confidence"),
        F.when(k == 0, "safe").when(k == 1, "block").when(k == 2, "escalate").otherwise("flag_pii").alias("verdict"),
        F.when(k != 0, F.concat(F.lit("before: "), d.cast("string"))).alias("reason"),
    ).drop("doc_id")


def incremental_run(spark, sf):
    files = run_files(spark, sf)
    return N.run_incremental(files, _run_snapshot(files.drop("text")), [I.ROOT])


_INTERNAL = f"regexp_matches(text, {S.quote(P.sql_pattern(V.INTERNAL_WORDS, True))})"


def _evidence_sql(source: str) -> str:
    """CTEs up to `evidence`: (doc_id, verdict, categories)."""
    secret = " OR ".join(f"list_contains(cats, '{c}')" for c in V.SECRET_CATEGORIES)
    return f"""{S.sanitized_cte(source)},
cats AS (SELECT doc_id, list_sort(list_distinct(list(category))) AS cats FROM detections GROUP BY doc_id),
evidence AS (
  SELECT s.doc_id, array_to_string(coalesce(cats, []), ',') AS categories,
         CASE WHEN {secret} THEN 'block' WHEN len(cats) > 0 THEN 'flag_pii' WHEN {_INTERNAL} THEN 'escalate' ELSE 'safe' END AS verdict
  FROM {source} s LEFT JOIN cats c ON s.doc_id = c.doc_id)"""


RUN_SQL = f"""
WITH {RUN_FILES}, {RUN_SNAPSHOT}, {_evidence_sql("files")},
judged AS (
  SELECT f.doc_id, f.path, f.text, {_KEY} AS cache_key, {_policy_sql(_CLEAN)} AS path_reason, {_image_sql()} AS gate
  FROM files f),
matched AS (
  SELECT j.*, o.verdict AS old_verdict, o.reason AS old_reason, o.confidence AS old_confidence, o.sanitized_text AS old_text,
         o.redaction_count AS old_n, {_DENIED} AS denied, NOT {_DENIED} AND gate IS NULL AND o.cache_key IS NOT NULL AS cached
  FROM judged j LEFT JOIN judged_before o ON j.cache_key = o.cache_key),
decided AS (
  SELECT m.*, CASE WHEN denied THEN 'deny' WHEN gate IS NOT NULL THEN 'escalate' WHEN cached THEN old_verdict ELSE e.verdict END AS verdict,
         CASE WHEN denied THEN path_reason WHEN gate IS NOT NULL THEN gate WHEN cached THEN old_reason
              WHEN e.verdict <> 'safe' THEN 'evidence: ' || e.categories END AS reason,
         CASE WHEN denied OR gate IS NOT NULL THEN NULL WHEN cached THEN old_confidence ELSE 1.0 END::DOUBLE AS confidence,
         s.sanitized_text AS clean, s.redaction_count AS n
  FROM matched m JOIN evidence e ON m.doc_id = e.doc_id JOIN sanitized s ON m.doc_id = s.doc_id)
SELECT doc_id, path, cache_key, verdict, CASE WHEN cached THEN 'cached' ELSE {_FORMAT} END AS format, reason, confidence,
       CASE WHEN verdict = 'deny' THEN 'deny_path' WHEN cached THEN 'cache_hit' WHEN verdict = 'safe' THEN 'classify_safe'
            WHEN verdict = 'block' THEN 'block_transfer' WHEN verdict = 'escalate' THEN 'escalate' ELSE 'sanitize' END AS action,
       CASE WHEN verdict = 'deny' THEN 'denied' WHEN gate IS NOT NULL THEN 'request_permission' WHEN verdict = 'safe' THEN 'classified-safe'
            WHEN verdict = 'escalate' THEN 'classified-escalate' WHEN verdict = 'block' THEN 'classified-block' ELSE 'regex-only' END AS method,
       cached, (CASE WHEN verdict <> 'flag_pii' THEN 0 WHEN cached THEN old_n ELSE n END)::INT AS redaction_count,
       CASE WHEN verdict = 'safe' THEN text WHEN verdict = 'flag_pii' AND cached THEN old_text WHEN verdict = 'flag_pii' THEN clean END AS content,
       CASE WHEN verdict = 'escalate' THEN replace({S.quote(V.REVIEW_MESSAGE)}, '{{reason}}', reason) END AS message
FROM decided"""


@query("run_incremental", RUN_SQL)
def run_incremental(spark, sf):
    return incremental_run(spark, sf).results


@query(
    "run_incremental_audit",
    f"SELECT action, method, count(*) AS n, sum(redaction_count)::BIGINT AS redactions FROM ({RUN_SQL}) GROUP BY ALL",
)
def run_incremental_audit(spark, sf):
    return (
        incremental_run(spark, sf)
        .audit.groupBy("action", "method")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("redaction_count").alias("redactions"))
    )


# --- verdicts -------------------------------------------------------------------------------

# Classifier answers of every kind: good, off-list, malformed, without arguments, missing.
@query(
    "map_verdict",
    """
WITH kinds AS (SELECT event_id, event_id % 7 AS k, event_type FROM events)
SELECT event_id,
       CASE k WHEN 0 THEN 'safe' WHEN 1 THEN 'flag_pii' WHEN 2 THEN 'block' WHEN 3 THEN 'escalate' WHEN 4 THEN 'escalate' WHEN 5 THEN 'flag_pii' ELSE 'flag_pii' END AS verdict,
       CASE k WHEN 0 THEN 'why ' || event_type WHEN 1 THEN 'email,ssn' WHEN 2 THEN 'classified as block_transfer'
              WHEN 3 THEN 'Could not parse model response' WHEN 4 THEN 'Could not parse model response' WHEN 5 THEN 'Classifier unavailable'
              ELSE 'classified as flag_pii' END AS reason,
       CASE k WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
       CASE k WHEN 1 THEN 'email|ssn' WHEN 5 THEN 'email|phone|ssn' WHEN 6 THEN 'email|phone|ssn' END AS pii_types
FROM kinds""",
)
def map_verdict(spark, sf):
    k = F.col("event_id") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit('{"tool":"classify_safe","arguments":{"reason":"why '), "event_type", F.lit('"},"confidence":0.75}')))
        .when(k == 1, '{"tool":"flag_pii","arguments":{"types":"email,ssn"}}')
        .when(k == 2, '{"tool":"block_transfer","arguments":{},"confidence":0.25}')
        .when(k == 3, '{"tool":"delete_all","arguments":{},"confidence":0.9}')
        .when(k == 4, '{"tool":"flag_pii","argu')
        .when(k == 6, '{"tool":"flag_pii","confidence":1.0}')
    )
    answers = I.table(spark, sf, "events").select("event_id", raw.alias("raw"), "event_type")
    return V.map_verdict(answers).select(
        "event_id", "verdict", "reason", "confidence", F.array_join("pii_types", "|").alias("pii_types")
    )


_CORPUS_EVIDENCE = f"{CORPUS}, {_evidence_sql('corpus')}"


@query("rule_verdict", f"WITH {_CORPUS_EVIDENCE} SELECT doc_id, verdict, categories FROM evidence")
def rule_verdict(spark, sf):
    return V.rule_verdict(I.corpus(spark, sf))


def _routed_input(spark, sf):
    """Verdict and redaction from the same spans."""
    found = I.corpus(spark, sf).withColumn("spans", find_spans("text"))
    judged = V.with_rule_verdict(found, spans="spans").withColumn(
        "reason", F.concat(F.lit("evidence: "), F.col("categories"))
    )
    return R.sanitize(judged, spans="spans").drop("spans", "method")


@query(
    "route_documents",
    f"""
WITH {_CORPUS_EVIDENCE}
SELECT s.doc_id, e.verdict, CASE e.verdict WHEN 'safe' THEN s.text WHEN 'flag_pii' THEN z.sanitized_text END AS content,
       CASE e.verdict WHEN 'safe' THEN 'classified-safe' WHEN 'flag_pii' THEN 'regex-only' WHEN 'escalate' THEN 'classified-escalate' ELSE 'classified-block' END AS method,
       (CASE WHEN e.verdict = 'flag_pii' THEN z.redaction_count ELSE 0 END)::INT AS count,
       CASE WHEN e.verdict = 'escalate' THEN replace({S.quote(V.REVIEW_MESSAGE)}, '{{reason}}', 'evidence: ' || categories) END AS escalation,
       CASE WHEN e.verdict = 'block' THEN 'evidence: ' || categories END AS block_reason
FROM corpus s JOIN evidence e ON s.doc_id = e.doc_id JOIN sanitized z ON s.doc_id = z.doc_id""",
)
def route_documents(spark, sf):
    return V.route_documents(_routed_input(spark, sf)).select(
        "doc_id", "verdict", "content", "method", "count", "escalation", "block_reason"
    )


@query(
    "audit_actions",
    f"""
WITH {_CORPUS_EVIDENCE}
SELECT CASE verdict WHEN 'safe' THEN 'classify_safe' WHEN 'block' THEN 'block_transfer' WHEN 'escalate' THEN 'escalate' ELSE 'sanitize' END AS action, count(*) AS n
FROM evidence GROUP BY ALL""",
)
def audit_actions(spark, sf):
    return V.audit_actions(V.rule_verdict(I.corpus(spark, sf)))
