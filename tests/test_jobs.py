import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators import features as X
from veilspark.operators import incremental as N
from veilspark.operators import model as M
from veilspark.operators import redact as R
from veilspark.operators.neighbors import knn_loo
from veilspark.session import scratch_path
from veilspark.sources import corpus as K
from veilspark.streaming import streams as W


def nearest_by_hand(ids, labels, vectors):
    v = np.asarray(vectors, dtype=np.float64)
    u = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    sims = np.round(u @ u.T, 9)
    np.fill_diagonal(sims, -np.inf)
    order = np.argsort(ids)
    out = {}
    for i, key in enumerate(ids):
        best = order[np.argmax(sims[i][order])]
        out[key] = (ids[best], labels[best], sims[i, best])
    return out


def neighbour_rows(kind):
    rng = np.random.default_rng(8)
    if kind == "clusters":
        centres = rng.normal(size=(5, 8))
        return [(i, int(i % 5), (centres[i % 5] + 0.1 * rng.normal(size=8)).tolist()) for i in range(300)]
    if kind == "copies":
        return [(i, int(i % 3), [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(240)]
    if kind == "scaled_and_zero":
        return [(i, i, [0.0, 0.0] if i % 10 == 9 else [float(1 + i % 4) * 0.1, float(1 + i % 4) * 0.2]) for i in range(40)]
    if kind == "pair":
        return [(5, 0, [1.0, 0.0]), (3, 1, [0.0, 1.0])]
    return [(i, int(i % 4), rng.normal(size=16).tolist()) for i in range(400)]


@pytest.mark.parametrize("kind", ["random", "clusters", "copies", "scaled_and_zero", "pair"])
def test_nearest_neighbour(spark, kind):
    rows = neighbour_rows(kind)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    got = knn_loo(df, pivots=12, block_rows=16, query_rows=64).collect()
    want = nearest_by_hand([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
    assert len(got) == len(rows)
    for r in got:
        neighbour, label, sim = want[r.vec_id]
        assert r.similarity == pytest.approx(sim, abs=2e-9)
        assert (r.neighbor, r.predicted) == (neighbour, label)


def test_near_copies_that_round_to_one_similarity(spark):
    base = np.zeros(4)
    base[0] = 1.0
    rows = [(5, "a", base), (9, "b", base + [0, 5e-4, 0, 0]), (10, "c", base + [0, 0, 5e-4, 0]), (20, "d", np.array([0.0, 0, 0, 1]))]
    df = spark.createDataFrame([(i, lab, v.tolist()) for i, lab, v in rows], "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: (r.neighbor, r.predicted) for r in knn_loo(df).collect()}
    assert got[10] == (5, "a") and got[9] == (5, "a")


def test_text_preparation(spark):
    df = spark.createDataFrame([(1, "a" * 200_000), (2, "b")], "doc_id long, text string")
    rows = {r.doc_id: r.prepared for r in X.prepare_text(df, "classify_doc").collect()}
    assert rows[2] == "Classify the following document: b" and len(rows[1]) == 33 + 200_000
    with pytest.raises(ValueError):
        X.prepare_text(df, "nope")
    assert X.prompt_grid(df).count() == 8


def test_unit_vectors_and_encoder(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0, 0.0]), (2, [0.0, 0.0, 0.0])], "id long, embedding array<double>")
    rows = {r.id: r.unit for r in X.normalize_vectors(df).collect()}
    assert rows[1] == [0.6, 0.8, 0.0] and rows[2] == [0.0, 0.0, 0.0]

    import pandas as pd

    @F.pandas_udf("array<float>")
    def encoder(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    out, model = X.featurize(docs, "none", encoder=encoder)
    assert model is None and abs(out.first().features.norm(2) - 1.0) < 1e-9


def test_encoder_loads_once_and_works_in_batches(spark):
    def load():
        class Model:
            def encode(self, texts):
                assert len(texts) <= 4
                return [[float(len(t)), float(len(texts))] for t in texts]

        return Model().encode

    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") + 1).cast("int")).alias("text"))
    rows, _ = X.featurize(docs.coalesce(1), "none", encoder=X.batch_encoder(load, batch=4))
    assert rows.count() == 10 and all(abs(r.features.norm(2) - 1) < 1e-6 for r in rows.collect())


def blobs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        c = i % 4
        rows.append((i, "abcd"[c], (np.eye(8)[c] * 3 + 0.3 * rng.normal(size=8)).tolist()))
    df = spark.createDataFrame(rows, "id long, label string, v array<double>")
    return df.select("id", "label", array_to_vector("v").alias("features"))


def test_training_prediction_registry(spark):
    df = blobs(spark)
    model = M.train_head(df, 1.0)
    scored = M.predict(model, df).collect()
    assert all(r.predicted == r.label and 0.25 < r.confidence <= 1.0 for r in scored)
    # a label the model has never seen is no obstacle to scoring
    assert M.predict(model, df.withColumn("label", F.lit("zzz"))).count() == 200
    path = scratch_path(spark, "model")
    sweep = spark.createDataFrame([("none", 1.0, 0.9, 0.1, 0.8, 0.2)], "prompt string, C double, mean_f1 double, std_f1 double, mean_acc double, std_acc double")
    from veilspark.operators.evaluate import cv_results_by_c

    M.save_model(model, path, "enc-v1", "none", 1.0, 200, cv_results_by_c(sweep, "none", 1.0))
    loaded, about = M.load_model(spark, path, "enc", "none")
    assert about.first().cv_results[1.0].macro_f1_mean == 0.9
    assert [r.predicted for r in M.predict(loaded, df).orderBy("id").collect()] == [r.predicted for r in sorted(scored, key=lambda r: r.id)]
    for wrong in (("other", "none"), ("enc", "classify_doc")):
        with pytest.raises(ValueError):
            M.load_model(spark, path, *wrong)


def test_cells_of_sparse_and_dense_vectors(spark):
    rows = [(1, Vectors.sparse(5, [1, 4], [2.0, -1.0])), (2, Vectors.dense([0.0, 3.0, 0.0])), (3, Vectors.sparse(4, [2], [0.0])), (4, Vectors.sparse(7, [], [])), (5, None)]
    df = spark.createDataFrame(rows, T.StructType().add("id", "long").add("features", VectorUDT()))
    got = {r.id: (r.width, r.cells and [tuple(c) for c in r.cells]) for r in df.select(
        "id", X.width(F.col("features")).alias("width"), X.cells(F.col("features")).alias("cells")).collect()}
    assert got[1] == (5, [(1, 2.0), (4, -1.0)]) and got[2] == (3, [(1, 3.0)]) and got[3] == (4, []) and got[4] == (7, [])
    assert got[5][1] is None


def test_texts_are_cut_once_for_features(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of the {i % 3} kind", "x") for i in range(20)] + [(20, None, None)], "id long, text string, more string")
    cut = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: (cut.add(1), t)[1])
    counted = docs.withColumn("text", seen.asNondeterministic()("text"))
    rows, model = X.featurize(counted, "classify_short", keep=["id"])
    assert rows.columns == ["id", "features"]
    got = {r.id: r.features for r in rows.collect()}
    assert rows.count() == 21 and cut.value == 21
    whole = X.featurize(docs, "classify_short")[0]
    assert whole.columns == ["id", "text", "more", "features"]
    assert {r.id: r.features for r in whole.collect()} == got == {r.id: r.features for r in model.transform(docs).collect()}
    assert got == {r.id: r.features for r in X.text_pipeline("classify_short").fit(docs).transform(docs).collect()}


def test_sweep(spark):
    scores = M.cv_sweep({"none": blobs(spark)}, "id", grid=(0.1, 10.0)).collect()
    assert len(scores) == 10 and all(s.f1 == 1.0 and s.acc == 1.0 for s in scores)


def test_heads_trained_together_equal_single_fits(spark):
    from pyspark.ml.classification import LogisticRegression

    from veilspark.operators import sweep as W

    rng = np.random.default_rng(9)
    rows = [(i, "abc"[i % 3], (np.eye(6)[i % 3] + rng.normal(size=6)).tolist()) for i in range(150)]
    rows += [(500, None, [0.0] * 6), (501, "a", None)]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>").select(
        "id", "label", F.when(F.col("v").isNotNull(), array_to_vector(F.coalesce("v", F.array(F.lit(0.0))))).alias("features"))
    wide = df.withColumn("features", F.when(F.col("features").isNotNull(), array_to_vector(F.concat(vector_to_array(F.coalesce("features", array_to_vector(F.array(F.lit(0.0))))), F.array(F.lit(0.5))))))
    folded = W.folded_rows({"one": df, "two": wide}, "id", 3, 42, "features")
    assert folded.count() == 300
    labels, heads = W.train_all(folded, (0.1, 10.0))
    assert labels == ["a", "b", "c"] and len(heads) == 2 * 2 * 3
    back = folded.select("prompt", "fold", F.instr(F.lit("abc"), F.col("label")).cast("double").alias("y"), array_to_vector(F.transform(
        F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get(F.filter("cells", lambda c: c["i"] == i), F.lit(0))["v"], F.lit(0.0)))).alias("x"))
    for prompt, c, fold in (("one", 0.1, 0), ("one", 10.0, 2), ("two", 10.0, 1)):
        part = back.where((F.col("prompt") == prompt) & (F.col("fold") != fold)).withColumn("y", F.col("y") - 1).cache()
        fit = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1 / (c * part.count()), standardization=False, tol=1e-10, maxIter=500).fit(part)
        got = heads[prompt, c, fold]
        assert np.abs(got[:, :-1] - fit.coefficientMatrix.toArray()).max() < 1e-3
        # a constant column shares its work with the intercept: their sum is what counts
        assert np.abs(got[:, -1] - fit.interceptVector.toArray()).max() < 1e-3


def test_sweep_counts_every_held_out_row(spark):
    from veilspark.operators import sweep as W

    folded = W.folded_rows({"none": blobs(spark)}, "id", 5, 42, "features")
    labels, heads = W.train_all(folded, (1.0,))
    counts = W.held_out_counts(folded, labels, heads).collect()
    assert sum(r.n for r in counts) == 200 and all(r.expected == r.predicted for r in counts)


def files_frame(spark):
    rows = [
        (1, "/c/a.txt", 10, 5, "mail a@b.com"), (2, "/c/b.txt", 10, 5, "mail b@b.com"), (3, "/c/c.txt", 10, 5, "plain"),
        (4, "/c/k.pem", 10, 5, "a@b.com"), (5, "/c/i.png", 10, 5, "a@b.com"), (6, "/c/s.txt", 10, 5, "key AKIA" + "Q" * 16), (7, "/c/n.txt", 10, 5, "strictly confidential"),
    ]
    return spark.createDataFrame(rows, "doc_id long, path string, mtime long, size_bytes long, text string")


def test_incremental_run(spark):
    files = files_frame(spark)
    schema = "cache_key string, path string, mtime long, size_bytes long, ruleset_version string, sanitized_text string, redaction_count int, method string, cached_at timestamp"
    first = N.run_incremental(files, spark.createDataFrame([], schema), ["/c"])
    actions = {r.doc_id: r.action for r in first.results.collect()}
    assert actions == {1: "sanitize", 2: "sanitize", 3: "classify_safe", 4: "deny_path", 5: "escalate", 6: "block_transfer", 7: "escalate"}
    contents = {r.doc_id: r.content for r in first.results.collect()}
    assert contents == {1: "mail __EMAIL_1__", 2: "mail __EMAIL_1__", 3: "plain", 4: None, 5: None, 6: None, 7: None}
    path = scratch_path(spark, "store")
    K.write_artifacts(first.artifacts, path)
    store = spark.read.parquet(path).drop("shard")
    changed = files.withColumn("mtime", F.when(F.col("doc_id") == 2, 99).otherwise(F.col("mtime")))
    second = N.run_incremental(changed, store, ["/c"])
    assert {r.doc_id: (r.action, r.cached) for r in second.results.where("verdict = 'flag_pii'").collect()} == {1: ("cache_hit", True), 2: ("sanitize", False)}
    hits, misses = N.cache_split(changed, store)
    assert sorted(r.doc_id for r in hits.collect()) == [1, 3, 6, 7] and misses.count() == 3
    assert N.cache_split(changed, store, ruleset="default-2")[0].count() == 0
    assert N.cache_split(changed, store, namespace=N.LAYOUT_NAMESPACE)[0].count() == 0
    assert second.artifacts.count() == 1
    merged = N.cache_upsert(store, second.artifacts)
    assert merged.count() == 6
    before = {r.doc_id: r for r in first.results.collect()}
    for r in second.results.collect():
        assert (r.verdict, r.content, r.reason, r.confidence, r.message) == tuple(before[r.doc_id][c] for c in ("verdict", "content", "reason", "confidence", "message"))
    assert before[6].reason == "evidence: SECRET" and "evidence: " in before[7].message and before[3].confidence == 1.0
    marked = N.run_incremental(files, store, ["/c"], max_bytes=4).results.where("doc_id = 1").first()
    assert marked.content == "mail __EMAIL_1__" and "exceeds 4-byte limit" in marked.reason
    old = store.drop("verdict", "reason", "confidence").where("sanitized_text is not null")
    assert {r.doc_id for r in N.run_incremental(files, old, ["/c"]).results.where("cached").collect()} == {1, 2}
    said = N.run_incremental(
        files, store.limit(0), ["/c"],
        judge=lambda d: d.withColumns({"verdict": F.lit("block"), "reason": F.lit("model"), "confidence": F.lit(0.5)})).results
    assert {(r.verdict, r.reason, r.confidence) for r in said.where("method = 'classified-block'").collect()} == {("block", "model", 0.5)}
    assert second.audit.count() == 7


def test_upsert_order_and_force(spark):
    schema = "cache_key string, ruleset_version string, v string, cached_at long"
    old = spark.createDataFrame([("k", "r", "old", 5), ("o", "r", "only", 1)], schema)
    new = spark.createDataFrame([("k", "r", "new", 3)], schema)
    assert {r.cache_key: r.v for r in N.cache_upsert(old, new).collect()} == {"k": "old", "o": "only"}
    assert {r.cache_key: r.v for r in N.cache_upsert(old, new, force=True).collect()} == {"k": "new", "o": "only"}


def test_corpus_and_logs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"ok \xff bad")
    (tmp_path / "sub" / "b.md").write_text("é")
    rows = {r.path.rsplit("/", 1)[1]: r for r in K.load_corpus(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "ok � bad" and rows["b.md"].text == "é" and rows["b.md"].size_bytes == 2
    assert K.load_corpus(spark, str(tmp_path), "*.md").count() == 1
    (tmp_path / "large").mkdir()
    (tmp_path / "large" / "l.txt").write_text("a" * 6 * 1024 * 1024)
    assert [len(r.text) for r in K.load_corpus(spark, str(tmp_path / "large")).collect()] == [6 * 1024 * 1024]
    (tmp_path / "large" / "l.txt").unlink()
    big = {r.size_bytes: r.text for r in K.load_corpus(spark, str(tmp_path), max_bytes=2).collect()}
    assert big == {8: None, 2: "é"}
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":\n{"a":2}\nnot json\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    good, bad = K.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema, keep_bad=True)
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 2
    log = str(tmp_path / "audit")
    event = spark.createDataFrame([("read", "block", "1999-01-01")], "event string, action string, t string")
    stamped = event.withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    K.write_audit(stamped, log)
    K.write_audit(stamped, log)
    back = K.read_audit(spark, log).collect()
    assert len(back) == 2 and all(r.timestamp.year > 2000 and r.path is None for r in back)


def test_streams_equal_batch(spark):
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    stream = W.read_stream(spark, sf, "documents.parquet", schema).select("doc_id", "text")
    got = {r.doc_id: r.sanitized_text for r in W.drain(W.stream_sanitize(stream), "t").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got == {r.doc_id: r.sanitized_text for r in R.sanitize(docs.select("doc_id", "text")).collect()}


def test_late_rows_and_repeats_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "ts timestamp, action string, path string, mtime long, size_bytes long"

    def add(rows):
        spark.createDataFrame(rows, "ts string, action string, path string, mtime long, size_bytes long").withColumn(
            "ts", F.col("ts").cast("timestamp")
        ).coalesce(1).write.mode("append").parquet(folder)

    parsed = T._parse_datatype_string(schema)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    out2, state2 = str(tmp_path / "out2"), str(tmp_path / "state2")

    def run():
        events = W.read_stream(spark, folder, "*.parquet", parsed)
        W.run_available(W.stream_audit_counts(events), out, state)
        W.run_available(W.stream_dedupe(events, "ts", "1 hour").select("path", "mtime"), out2, state2)

    add([("2024-01-01 00:10:00", "read", "/a", 1, 1), ("2024-01-01 03:00:00", "read", "/b", 1, 1)])
    run()
    add([("2024-01-01 00:20:00", "read", "/late", 1, 1), ("2024-01-01 03:10:00", "read", "/b", 1, 1), ("2024-01-01 06:00:00", "read", "/b", 2, 1)])
    run()
    counts = sorted((str(r.window_start), r.n) for r in spark.read.parquet(out).collect())
    assert counts == [("2024-01-01 00:00:00", 1), ("2024-01-01 03:00:00", 2)]
    seen = sorted((r.path, r.mtime) for r in spark.read.parquet(out2).collect())
    assert seen == [("/a", 1), ("/b", 1), ("/b", 2)]
