"""Labelled corpora: manifests, provenance, validation, quotas, duplicates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.ranking import hash_chunk, number_sorted, number_within
from veilspark.operators.detect import any_rule, live_secret_rules
from veilspark.operators.verdict import LABELS

# --- fixed values ---------------------------------------------------------
MIN_CHARS = 300
SIGNAL_MIN_CHARS = 200
SIDECAR_SUFFIX = ".provenance.json"
README_NAME = "README.md"
FOLDS = 5
REASON_SHORT = "too short ({n} < {least})"
REASON_ECHO = "echoes scenario instruction"
REASON_NO_PII = "flag_pii output contains no detectable PII pattern"
REASON_NO_SECRET = "block_transfer output contains no detectable secret pattern"
SIGNAL_SHORT = "too short ({n} chars)"
SIGNAL_NO_EMAIL = "no email-shaped tokens"
SIGNAL_NO_SECRET = "no credential-shaped key=value lines"
# ----------------------------------------------------------------------------
PROVENANCE_SCHEMA = (
    "struct<label:string,source_repo:string,source_path:string,source_blob_sha:string,source_url:string,"
    "fetched_at:string,length_chars:int,collector_query_terms:array<string>,"
    "collector_extra_flags:array<string>,hand_assigned_label:string,relabel_note:string>"
)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def labeled_manifest(
    files: DataFrame, manifest: DataFrame, root: str, labels: Sequence[str] = LABELS
) -> DataFrame:
    """(path, label), sorted, from label folders under `root` and from a manifest.

    `manifest` has (path, label); its entries count only where the file exists.
    Sidecars, README files and folders that are no label are left out.
    """
    below = F.regexp_extract("path", "^" + root.rstrip("/") + "/([^/]+)/[^/]+$", 1)
    foldered = (
        files.select("path", below.alias("label"))
        .where(F.col("label").isin(*labels))
        .where(~F.endswith("path", F.lit(SIDECAR_SUFFIX)) & (base_name(F.col("path")) != README_NAME))
    )
    listed = manifest.select("path", "label").join(files.select("path"), "path", "left_semi")
    return foldered.unionByName(listed).orderBy("path", "label")


def provenance_join(files: DataFrame) -> DataFrame:
    """(scenario_id, path, label, text) of mined files that have a provenance sidecar.

    `files` has (path, text), contents and sidecars alike.  A label given by hand
    outranks the collector's; files without either are dropped.
    """
    is_sidecar = F.endswith("path", F.lit(SIDECAR_SUFFIX))
    about = F.from_json(F.col("text"), PROVENANCE_SCHEMA)
    chosen = F.coalesce(F.nullif(about.hand_assigned_label, F.lit("")), F.nullif(about.label, F.lit("")))
    sidecars = files.where(is_sidecar).select(
        F.regexp_replace("path", r"\.provenance\.json$", "").alias("path"), chosen.alias("label")
    )
    stem = F.regexp_replace(base_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    parent = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    return (
        files.where(~is_sidecar)
        .join(sidecars.where(F.col("label").isNotNull()), "path")
        .select(F.concat_ws(":", F.lit("mined"), parent, stem).alias("scenario_id"), "path", "label", "text")
    )


def number_scenarios(rows: DataFrame, order: str) -> DataFrame:
    """Adds scenario_id `<label>:<n>`, n from 0 per label along a sortable `order` column."""
    numbered = number_sorted(rows, ["label"], [order], "_n")
    return numbered.withColumn(
        "scenario_id", F.concat(F.col("label"), F.lit(":"), (F.col("_n") - 1).cast("string"))
    ).drop("_n")


def build_training_set(curated: DataFrame, mined: DataFrame, order: str = "doc_id") -> DataFrame:
    """(scenario_id, label, text): numbered curated rows followed by mined rows with their own ids."""
    own = number_scenarios(curated, order).select("scenario_id", "label", "text")
    return own.unionByName(mined.select("scenario_id", "label", "text"))


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def write_training_set(rows: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines.  Appending is how a stopped run is taken up again."""
    rows.select("scenario_id", "label", "text").write.mode(mode).json(path)


def resume_pending(scenarios: DataFrame, done: DataFrame) -> DataFrame:
    """The scenarios that have no row in the output yet."""
    return scenarios.join(done.select("scenario_id"), "scenario_id", "left_anti")


def with_count(message: str, n: Column) -> Column:
    return F.replace(F.lit(message), F.lit("{n}"), n.cast("string"))


def validation_reason(label: Column, text: Column, scenario: Column) -> Column:
    """Why a generated text is rejected; empty if it is good."""
    size = F.length(text)
    echo = F.contains(F.lower(text), F.lower(scenario))
    return (
        F.when(size < MIN_CHARS, with_count(REASON_SHORT.replace("{least}", str(MIN_CHARS)), size))
        .when(echo, REASON_ECHO)
        .when((label == "flag_pii") & ~any_rule(text, P.PII_RULES), REASON_NO_PII)
        .when((label == "block_transfer") & ~any_rule(text, P.SECRET_RULES), REASON_NO_SECRET)
        .otherwise("")
    )


def validate_rows(rows: DataFrame) -> DataFrame:
    """Adds `reason` and `ok` to (label, text, scenario)."""
    return rows.withColumn(
        "reason", validation_reason(F.col("label"), F.col("text"), F.col("scenario"))
    ).withColumn("ok", F.col("reason") == "")


def signal_reason(label: Column, text: Column) -> Column:
    """Why a mined text does not look like its label; empty if it does."""
    size = F.length(text)
    email = F.rlike(text, F.lit(P.spark_pattern(P.SIGNAL_EMAIL, unicode_words=True)))
    secret = F.rlike(text, F.lit(P.spark_pattern(P.SIGNAL_SECRET, unicode_words=True)))
    return (
        F.when(size < SIGNAL_MIN_CHARS, with_count(SIGNAL_SHORT, size))
        .when((label == "flag_pii") & ~(F.contains(text, F.lit("@")) & email), SIGNAL_NO_EMAIL)
        .when((label == "block_transfer") & ~secret, SIGNAL_NO_SECRET)
        .otherwise("")
    )


def class_signal(rows: DataFrame) -> DataFrame:
    """Adds `reason` and `ok` to (label, text)."""
    return rows.withColumn("reason", signal_reason(F.col("label"), F.col("text"))).withColumn(
        "ok", F.col("reason") == ""
    )


def first_per_label(rows: DataFrame, order: Sequence[str | Column], quota: int) -> DataFrame:
    """The first `quota` rows of each label.

    The rank limit runs in every task before the shuffle, so a label that holds
    most of the rows sends at most `quota` rows per task.
    """
    ranked = Window.partitionBy("label").orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= quota).drop("_rank")


def collect_quota(candidates: DataFrame, quota: int) -> DataFrame:
    """Candidates that pass the live-secret guard and the label's signal, up to a quota per label.

    `candidates` has (label, query_rank, hit_rank, text); the queries are worked
    through in order.  The quota is the feature: it is set by the caller and bounds the rows
    that are collected for training.
    """

    def passes(text: Column) -> Column:
        long_enough = F.length(text) >= SIGNAL_MIN_CHARS
        return long_enough & (F.size(live_secret_rules(text)) == 0) & (signal_reason(F.col("label"), text) == "")

    # a filter would be moved below the shuffle that spreads the rows and make the text anew for every test
    good = candidates.withColumn("text", F.explode(F.filter(F.array("text"), passes)))
    return first_per_label(good, ["query_rank", "hit_rank"], quota)


def cap_per_class(rows: DataFrame, cap: int, order: Sequence[str]) -> DataFrame:
    """At most `cap` rows of each label, which bounds the rows a model is trained on."""
    return first_per_label(rows, order, cap)


def first_valid_attempt(attempts: DataFrame) -> DataFrame:
    """(scenario_id, attempt, text, status) of each scenario's first valid attempt, else its last reason.

    `attempts` has (scenario_id, attempt, label, text, scenario); a null text is
    a failed call.
    """
    checked = attempts.withColumn(
        "_reason",
        F.when(F.col("text").isNull(), "no response").otherwise(
            validation_reason(F.col("label"), F.col("text"), F.col("scenario"))
        ),
    )
    ok = F.col("_reason") == ""
    best = checked.groupBy("scenario_id").agg(
        F.min(F.when(ok, F.col("attempt"))).alias("attempt"),
        F.max_by("_reason", "attempt").alias("_last"),
    )
    texts = attempts.select("scenario_id", "attempt", "text")
    return best.join(texts, ["scenario_id", "attempt"], "left").select(
        "scenario_id",
        "attempt",
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("attempt").isNotNull(), "ok").otherwise(F.col("_last")).alias("status"),
    )


def content_hash(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def content_dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(content_hash, name, keeper, copies): each content once, under its lowest key.

    Only hashes and keys are grouped, counted map-side, so a text with very many
    copies costs one row per task.  `name` is the short form used in file names;
    equality is by the full hash.
    """
    return (
        docs.select(content_hash(F.col(text)).alias("content_hash"), key)
        .groupBy("content_hash")
        .agg(F.min(key).alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .select("content_hash", F.substring("content_hash", 1, 24).alias("name"), "keeper", "copies")
    )


def without_overlap(docs: DataFrame, other: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose content is not in the other set."""
    seen = other.select(content_hash(F.col(text)).alias("_hash")).distinct()
    return docs.withColumn("_hash", content_hash(F.col(text))).join(seen, "_hash", "left_anti").drop("_hash")


def stratified_folds(rows: DataFrame, key: str, seed: int = 42, folds: int = FOLDS) -> DataFrame:
    """Adds `fold`, giving every label equal shares in every fold (within one row).

    Rows of a label are put in the order of a seeded hash of their key and dealt
    out in turn; the order is built from chunks of the hash.
    """
    shuffled = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    numbered = number_within(shuffled, ["label"], hash_chunk(F.col("_h")), ["_h", key], "_n")
    return numbered.withColumn("fold", ((F.col("_n") - 1) % folds).cast("int")).drop("_h", "_n")
