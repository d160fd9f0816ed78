"""Inputs that the named queries derive from the given tables, in Spark and in SQL.

Each pair holds the same expression twice, so that a query and its SQL twin see
the same rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "/corpus"

EXTENSIONS = (
    ".txt", ".md", ".json", ".csv", ".html", ".py", ".png", ".pem", ".pdf", ".docx",
    "/.env", ".jsonl", ".tsv", ".PNG", ".xyz", "", "/.env.local",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than there are cores.

    This is for the given small tables, which are one row group and cannot be split by the
    reader; it changes no result.  A large table has more splits than cores and is read as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- files: documents with a path, a size and a time ----------------------------

FILES_SQL = f"""
SELECT doc_id,
       CASE doc_id % 19 WHEN 0 THEN '/other/' WHEN 1 THEN '/corpus2/' WHEN 2 THEN '/corpus/docs/'
            WHEN 3 THEN '/corpus/tmp/../' WHEN 4 THEN '/corpus/../other/' WHEN 5 THEN '/corpus/.ssh/'
            ELSE '/corpus/' || source || '/' || lang || '/' END
         || doc_id::VARCHAR || ({_sql_list(EXTENSIONS)})[(doc_id % {len(EXTENSIONS)})::INT + 1] AS path,
       1700000000000 + doc_id * 60000 AS mtime,
       n_chars * (1 + 200 * (doc_id % 4)) AS size_bytes,
       text, lang, source
FROM documents"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    own = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"))
    kind = F.col("doc_id") % 19
    folder = (
        F.when(kind == 0, "/other/").when(kind == 1, "/corpus2/").when(kind == 2, "/corpus/docs/")
        .when(kind == 3, "/corpus/tmp/../").when(kind == 4, "/corpus/../other/").when(kind == 5, "/corpus/.ssh/")
        .otherwise(own)
    )
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    return d.select(
        "doc_id",
        F.concat(folder, F.col("doc_id").cast("string"), ext).alias("path"),
        (F.lit(1700000000000) + F.col("doc_id") * 60000).alias("mtime"),
        (F.col("n_chars") * (1 + 200 * (F.col("doc_id") % 4))).alias("size_bytes"),
        "text", "lang", "source",
    )


# --- records: one line of personal data and secrets per customer ----------------

RECORD_BASE = 1_000_000_000

RECORDS_SQL = f"""
SELECT {RECORD_BASE} + c_custkey AS doc_id,
       'Customer ' || c_name || ': SSN ' || lpad((k % 1000)::VARCHAR, 3, '0') || '-' || lpad((k % 100)::VARCHAR, 2, '0')
         || '-' || lpad((k % 10000)::VARCHAR, 4, '0') || ', IBAN DE' || lpad((k % 100)::VARCHAR, 2, '0') || lpad(k::VARCHAR, 12, '0')
         || ', key AKIA' || lpad(k::VARCHAR, 16, '0') || ', mail c' || k || '@example.com, phone (212) 555-' || lpad((k % 10000)::VARCHAR, 4, '0')
         || chr(10) || 'see https://api.example.net/10.0.0.' || (k % 256) || '/user/' || k || ' via 10.1.2.' || (k % 256)
         || ', card 4' || lpad(k::VARCHAR, 15, '0') || chr(10) || 'password = "Pw' || k || 'xyz!" at ' || (k % 900 + 1) || ' North Main Street'
         || chr(10) || 'token ghp_' || substr(md5(k::VARCHAR) || md5((k + 1)::VARCHAR), 1, 36)
         || ' id ' || md5(k::VARCHAR) || upper(md5((k + 7)::VARCHAR)) || ' mail c' || k || '@example.com' || chr(10) AS text,
       'en' AS lang, 'crm' AS source
FROM (SELECT c_custkey, c_name, c_custkey AS k FROM customer)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    pad = lambda c, n: F.lpad(s(c), n, "0")
    parts = [
        "Customer ", F.col("c_name"), ": SSN ", pad(k % 1000, 3), "-", pad(k % 100, 2), "-", pad(k % 10000, 4),
        ", IBAN DE", pad(k % 100, 2), pad(k, 12), ", key AKIA", pad(k, 16), ", mail c", s(k),
        "@example.com, phone (212) 555-", pad(k % 10000, 4), "\nsee https://api.example.net/10.0.0.", s(k % 256),
        "/user/", s(k), " via 10.1.2.", s(k % 256), ", card 4", pad(k, 15), '\npassword = "Pw', s(k),
        'xyz!" at ', s(k % 900 + 1), " North Main Street", "\ntoken ghp_",
        F.substring(F.concat(F.md5(s(k)), F.md5(s(k + 1))), 1, 36),
        " id ", F.md5(s(k)), F.upper(F.md5(s(k + 7))), " mail c", s(k), "@example.com\n",
    ]
    return spread(table(spark, sf, "customer")).select(
        (F.lit(RECORD_BASE) + k).cast("long").alias("doc_id"),
        F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"),
        F.lit("en").alias("lang"),
        F.lit("crm").alias("source"),
    )


CORPUS_SQL = f"SELECT doc_id, text, lang, source FROM documents UNION ALL {RECORDS_SQL}"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return docs.unionByName(records(spark, sf))


# --- labelled rows -----------------------------------------------------------------

LABEL_SQL = "CASE WHEN toxic = 1 THEN (CASE WHEN quality = 1 THEN 'block_transfer' ELSE 'request_permission' END) WHEN quality = 1 THEN 'classify_safe' ELSE 'flag_pii' END"
LABELED_SQL = f"SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, {LABEL_SQL} AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def label_column():
    bad, good = F.col("toxic") == 1, F.col("quality") == 1
    return (
        F.when(bad & good, "block_transfer").when(bad, "request_permission")
        .when(good, "classify_safe").otherwise("flag_pii")
    )


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    marks = table(spark, sf, "labels").select("doc_id", label_column().alias("label"))
    return docs.join(marks, "doc_id").select("doc_id", "text", "lang", "source", "n_chars", "label")


# --- predictions of a classifier run, from events ------------------------------------

PREDICTIONS_SQL = """
SELECT event_id AS case_id,
       (['classify_safe', 'flag_pii', 'block_transfer', 'request_permission'])[(user_id % 4)::INT + 1] AS expected,
       CASE event_type WHEN 'view' THEN 'classify_safe' WHEN 'click' THEN 'flag_pii' WHEN 'purchase' THEN 'block_transfer'
            WHEN 'signup' THEN 'request_permission'
            ELSE CASE WHEN value > 20 THEN 'unknown_tool'
                      ELSE (['classify_safe', 'flag_pii', 'block_transfer', 'request_permission'])[(user_id % 4)::INT + 1] END
       END AS predicted,
       event_type AS run, value AS latency_ms
FROM events"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("classify_safe", "flag_pii", "block_transfer", "request_permission")])
    expected = F.get(names, (F.col("user_id") % 4).cast("int"))
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("case_id"),
        expected.alias("expected"),
        F.when(kind == "view", "classify_safe").when(kind == "click", "flag_pii")
        .when(kind == "purchase", "block_transfer").when(kind == "signup", "request_permission")
        .when(F.col("value") > 20, "unknown_tool").otherwise(expected).alias("predicted"),
        kind.alias("run"),
        F.col("value").alias("latency_ms"),
    )


# --- text runs on pages, from the lines of documents -----------------------------------

RUNS_SQL = """
SELECT doc_id, CAST((line - 1) // 50 AS INT) AS page, line AS run, text,
       72.0 + (doc_id % 7) AS x, ((line - 1) % 50) * 12.0 + ((doc_id + line) % 3) * 0.4 AS y,
       length(text) * 5.5 AS width,
       CASE WHEN line % 5 = 0 THEN 0.0 WHEN line % 5 = 1 THEN NULL ELSE 9.0 + line % 5 END AS height
FROM (SELECT doc_id, unnest(l) AS text, unnest(range(1, len(l) + 1))::INT AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({source})))"""


def runs(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("_i", "text"))
    line = F.col("_i") + 1
    return lines.select(
        "doc_id",
        F.floor(F.col("_i") / 50).cast("int").alias("page"),
        line.cast("int").alias("run"),
        "text",
        (F.lit(72.0) + F.col("doc_id") % 7).alias("x"),
        ((F.col("_i") % 50) * 12.0 + ((F.col("doc_id") + line) % 3) * F.lit(0.4)).alias("y"),
        (F.length("text") * 5.5).alias("width"),
        F.when(line % 5 == 0, 0.0).when(line % 5 == 1, None).otherwise(F.lit(9.0) + line % 5).alias("height"),
    )
