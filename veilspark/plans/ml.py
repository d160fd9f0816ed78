"""Named queries: text preparation, features, training, neighbours."""
from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veilspark.operators import classify as K
from veilspark.operators import evaluate as E
from veilspark.operators import features as X
from veilspark.operators import model as M
from veilspark.operators import redact as R
from veilspark.operators import verdict as V
from veilspark.operators.curate import stratified_folds
from veilspark.operators.neighbors import knn_loo as nearest
from veilspark.plans import inputs as I
from veilspark.plans import sql_text as S
from veilspark.plans.catalog import query
from veilspark.plans.scores import rounded
from veilspark.session import scratch_path, write_through


@query(
    "prepare_text",
    f"""
SELECT doc_id, prompt, prefix || text AS prepared
FROM documents, (VALUES {", ".join(f"({S.quote(t)}, {S.quote(X.PROMPTS[t])})" for t in X.PROMPT_GRID)}) AS p(prompt, prefix)""",
)
def prepare_text(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return X.prompt_grid(docs).select("doc_id", "prompt", "prepared")


@query(
    "prepare_text_marked",
    "SELECT doc_id, 'Classify the following document: ' || text AS prepared FROM documents",
)
def prepare_text_marked(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return X.prepare_text(docs, "classify_doc").select("doc_id", "prepared")


# TF-IDF over md5 buckets, as in the pipeline: one weight per document and bucket.
def _weights_sql(source: str, prompt: str = "") -> str:
    return f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower({S.quote(prompt)} || text), '[a-z0-9_]+')) AS w FROM {source}),
tf AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 3))::INT AS b, count(*) AS n FROM tok GROUP BY ALL),
df AS (SELECT b, ln(((SELECT count(*) FROM {source}) + 1) / (count(*) + 1.0)) AS idf FROM tf GROUP BY b),
weights AS (SELECT doc_id, tf.b, n * idf AS v FROM tf JOIN df ON tf.b = df.b WHERE n * idf <> 0)"""


@query(
    "featurize",
    f"""
WITH {_weights_sql("documents", X.PROMPTS["classify_short"])},
sized AS (SELECT doc_id, b, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS u FROM weights)
SELECT d.doc_id, count(b)::INT AS terms, round(coalesce(sqrt(sum(u * u)), 0), 6)::DOUBLE AS length, round(coalesce(sum(u * (b + 1)), 0), 3)::DOUBLE AS mass
FROM documents d LEFT JOIN sized s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
)
def featurize(spark, sf):
    """Terms, length and the weights' sum by place, of every document."""
    docs = I.spread(I.table(spark, sf, "documents").select("doc_id", "text"))
    rows, _ = X.featurize(docs, "classify_short", keep=["doc_id"])
    rows = rows.select("doc_id", X.cells(F.col("features")).alias("cells"))
    return rows.select(
        "doc_id",
        F.size("cells").alias("terms"),
        F.round(X.norm(F.col("cells.v")), 6).alias("length"),
        F.round(F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["v"] * (c["i"] + 1)), 3).alias("mass"),
    )


@query(
    "normalize_stats",
    """
WITH n AS (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size, embedding FROM embeddings),
u AS (SELECT label, size, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / size) * (x::DOUBLE / size)))) AS after FROM n)
SELECT label, count(*) AS n, round(min(size), 6) AS min_norm, round(avg(size), 6) AS mean_norm, round(max(size), 6) AS max_norm,
       round(min(after), 6) AS min_unit, round(max(after), 6) AS max_unit FROM u GROUP BY label""",
)
def normalize_stats(spark, sf):
    stats = X.normalize_stats(I.table(spark, sf, "embeddings"))
    return rounded(stats, "min_norm", "mean_norm", "max_norm", "min_unit", "max_unit")


HELD_OUT = 0


def _folded(spark, sf):
    """Labelled documents with a fold, stored."""
    rows = I.labeled(spark, sf).select("doc_id", "text", "label")
    return write_through(spark, stratified_folds(rows, "doc_id", M.SEED), "labeled")


_FOLDED_SQL = f"""
labeled AS ({I.LABELED_SQL}),
folded AS (SELECT doc_id, text, label, (row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':{M.SEED}'), doc_id) - 1) % 5 AS fold FROM labeled)"""


def _head(model):
    """(labels, coefficient matrix, intercepts) of a trained bundle."""
    head = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    names = next(s for s in model.stages if isinstance(s, IndexToString))
    return names.getLabels(), head.coefficientMatrix.toArray(), head.interceptVector.toArray()


@query(
    "train_head",
    f"WITH {_FOLDED_SQL} SELECT label, count(*) AS n, true AS at_optimum FROM folded WHERE fold <> {HELD_OUT} GROUP BY label",
)
def train_head(spark, sf):
    """Train on the texts of four folds; at the coefficients the loss has no slope left for any class.

    The slope is computed from the rows: the mean of (probability - hit) times the features, and the
    penalty's share.
    """
    rows = _folded(spark, sf).where(F.col("fold") != HELD_OUT)
    model = K.train_classifier(rows)
    labels, weights, _ = _head(model)
    n = rows.count()
    scored = PipelineModel([s for s in model.stages if not isinstance(s, (IndexToString, StringIndexerModel))]).transform(rows)
    p = vector_to_array("_probability")
    scored = scored.select(X.cells(F.col("features")).alias("cells"), F.array(*[
        F.get(p, F.lit(k)) - (F.col("label") == label).cast("double") for k, label in enumerate(labels)]).alias("off"))
    # one row per place, whatever the number of documents; places without a cell have no slope but the penalty's
    sums = scored.select("off", F.inline("cells")).groupBy("i").agg(
        *[F.sum(F.col("v") * F.get("off", F.lit(k))).alias(f"s{k}") for k in range(len(labels))])
    means = np.zeros_like(weights)
    for r in sums.collect():
        means[:, r.i] = [r[f"s{k}"] / n for k in range(len(labels))]
    flat = [(label, bool(np.linalg.norm(means[k] + weights[k] / n) < 1e-2)) for k, label in enumerate(labels)]
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(spark.createDataFrame(flat, "label string, at_optimum boolean"), "label")


@query(
    "predict",
    f"WITH {_FOLDED_SQL} SELECT doc_id, label AS expected, true AS as_recomputed, true AS in_range FROM folded WHERE fold = {HELD_OUT}",
)
def predict(spark, sf):
    """Score the held-out fold; label and probability are computed again from the coefficients."""
    folded = _folded(spark, sf)
    model = K.train_classifier(folded.where(F.col("fold") != HELD_OUT))
    labels, weights, intercepts = _head(model)
    scored = M.predict(model, folded.where(F.col("fold") == HELD_OUT)).withColumn("x", vector_to_array("features"))

    def margin(k):
        w = F.from_json(F.lit(json.dumps(weights[k].tolist())), "array<double>")
        return F.aggregate(F.zip_with("x", w, lambda x, y: x * y), F.lit(float(intercepts[k])), lambda acc, v: acc + v)

    margins = F.array(*[F.struct(margin(k).alias("m"), F.lit(label).alias("name")) for k, label in enumerate(labels)])
    again = scored.select("doc_id", "label", "predicted", "confidence", margins.alias("all"))
    best = F.array_max("all")
    share = 1 / F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.exp(x.m - best.m))
    return again.select(
        "doc_id",
        F.col("label").alias("expected"),
        ((best["name"] == F.col("predicted")) & (F.abs(share - F.col("confidence")) < 1e-6)).alias("as_recomputed"),
        F.col("confidence").between(0.25, 1.0).alias("in_range"),
    )


@query("classify_documents")
def classify_documents(spark, sf):
    """Train on four folds, judge the documents of the fifth, and route them by the verdict."""
    folded = _folded(spark, sf)
    model = K.train_classifier(folded.where(F.col("fold") != HELD_OUT))
    judged = K.classify(folded.where(F.col("fold") == HELD_OUT), model)
    return V.route_documents(R.sanitize(judged).drop("marks", "method")).select(
        "doc_id", F.col("label").alias("expected"), "predicted", F.round("confidence", 4).alias("confidence"),
        "verdict", "method", "count", "content", "escalation", "block_reason")


@query("cv_sweep")
def cv_sweep(spark, sf):
    """Every labelled text under the four prompts of the grid."""
    rows = I.labeled(spark, sf).select("doc_id", "text", "label")
    texts = {task: X.featurize(rows, task, keep=["doc_id", "label"])[0] for task in X.PROMPT_GRID}
    summary = E.sweep_summary(M.cv_sweep(texts, "doc_id", grid=M.C_GRID))
    # settings that are equal but for the order of sums tie
    return E.select_winner(rounded(summary, "mean_f1", "std_f1", "mean_acc", "std_acc"))


@query(
    "model_registry",
    f"WITH {_FOLDED_SQL} SELECT doc_id, label AS expected, true AS same FROM folded WHERE fold = {HELD_OUT}",
)
def model_registry(spark, sf):
    """Train on texts, save, refuse a wrong prompt, load, and score the held-out texts as before."""
    folded = _folded(spark, sf)
    rows, new = folded.where(F.col("fold") != HELD_OUT), folded.where(F.col("fold") == HELD_OUT)
    n = rows.count()
    path = scratch_path(spark, "model")
    features = X.featurize(rows.select("doc_id", "text", "label"), "classification", keep=["doc_id", "label"])[0]
    scores = M.cv_sweep({"classification": features}, "doc_id", grid=(1.0,))
    results = E.cv_results_by_c(E.sweep_summary(scores), "classification", 1.0)
    model = K.train_classifier(rows, "classification")
    M.save_model(model, path, "md5-buckets-3", "classification", 1.0, n, results)
    try:
        M.load_model(spark, path, "md5-buckets", "classify_doc")
        raise AssertionError("a model for another prompt was accepted")
    except ValueError:
        pass
    loaded, _ = M.load_model(spark, path, "md5-buckets", "classification")
    before = K.classify(new, model).select("doc_id", "label", F.col("predicted").alias("was"))
    after = K.classify(new, loaded).select("doc_id", "predicted")
    return before.join(after, "doc_id").select("doc_id", F.col("label").alias("expected"), (F.col("was") == F.col("predicted")).alias("same"))


_UNITS = """
units AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) AS u FROM embeddings)"""

KNN_SQL = f"""
WITH {_UNITS},
pairs AS (SELECT a.vec_id, a.label AS expected, b.vec_id AS neighbor, b.label AS predicted, round(list_dot_product(a.u, b.u), 9) AS sim
          FROM units a, units b WHERE a.vec_id <> b.vec_id)
SELECT vec_id, expected, neighbor, predicted, round(sim, 6) AS similarity FROM pairs
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbor) = 1"""


@query("knn_loo", KNN_SQL)
def knn_loo(spark, sf):
    return rounded(nearest(I.table(spark, sf, "embeddings")), "similarity")


# Which neighbours an index misses has no SQL form; tests hold its recall against the exact query.
@query("knn_index")
def knn_index(spark, sf):
    return rounded(nearest(I.table(spark, sf, "embeddings"), recall=0.95), "similarity")


@query(
    "knn_report",
    f"""
WITH knn AS ({KNN_SQL}), l AS (SELECT DISTINCT label FROM embeddings),
c AS (SELECT l.label, count(CASE WHEN expected = l.label AND predicted = l.label THEN 1 END) AS tp,
        count(CASE WHEN expected <> l.label AND predicted = l.label THEN 1 END) AS fp,
        count(CASE WHEN expected = l.label AND predicted <> l.label THEN 1 END) AS fn FROM l CROSS JOIN knn GROUP BY l.label)
SELECT label::VARCHAR AS label, tp + fn AS support, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1 FROM c""",
)
def knn_report(spark, sf):
    vectors = I.table(spark, sf, "embeddings")
    found = nearest(vectors).select(
        F.col("expected").cast("string").alias("expected"), F.col("predicted").cast("string").alias("predicted")
    )
    labels = [str(r.label) for r in vectors.select("label").distinct().collect()]
    return rounded(E.class_report(found, labels).select("label", "support", "f1"), "f1")
