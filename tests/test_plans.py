import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from veilspark.operators import redact as R
from veilspark.plans import catalog
from veilspark.plans import inputs as I

SF = "/root/testdata/sf0.001"
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas")


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def nodes(plan, name):
    """Occurrences of a node in the plan's tree."""
    tree = plan.split("\n\n")[0]
    return len(re.findall(rf"\b{name}\b", tree))


NEIGHBOURS = {"knn_loo", "knn_report", "knn_index"}
AUTOMATON = {"redact_known_values"}
ACTIONS = {"cv_sweep", "train_head", "predict", "model_registry", "classify_documents", "featurize"}


def test_every_query_has_a_twin_unless_sql_cannot_say_it():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"cv_sweep", "classify_documents", "knn_index", "latency_approximate"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - NEIGHBOURS - AUTOMATON - ACTIONS))
def test_no_python_workers_and_no_cross_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert not any(p in plan for p in PYTHON)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sanitize_reads_once_and_does_not_shuffle(spark):
    docs = I.table(spark, SF, "documents")
    plan = plan_of(R.sanitize(docs).select("doc_id", "sanitized_text", "redaction_count"))
    assert nodes(plan, "Scan parquet") == 1 and nodes(plan, "Exchange") == 0
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read == ["doc_id:bigint,text:string"]


def test_placeholders_find_the_spans_once(spark):
    plan = plan_of(R.assign_placeholders(I.table(spark, SF, "documents")))
    ssn = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
    # the gate in front, the gate inside, the match and the gaps
    assert 0 < plan.count(ssn) <= 8


def test_quota_limits_before_the_shuffle(spark):
    plan = plan_of(entry.queries()["cap_per_class"](spark, SF))
    assert nodes(plan, "WindowGroupLimit") == 2


def test_dedupe_shuffles_hashes_only(spark):
    plan = plan_of(entry.queries()["content_dedupe"](spark, SF))
    exchanged = re.search(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan).group(1)
    assert "text" not in exchanged


def test_known_files_meet_no_pattern_and_no_text_is_shuffled(spark, tmp_path):
    """With every file known, texts are read for safe ones only, and picked without an exchange."""
    from veilspark.operators import incremental as N

    files = I.files(spark, SF)
    known = N.with_cache_key(files.drop("text")).selectExpr(
        "cache_key", "path", "mtime", "size_bytes", f"'{N.RULESET}' ruleset_version", "'flag_pii' verdict",
        "'clean' sanitized_text", "1 redaction_count", "'regex-only' method", "0L cached_at")
    known.write.parquet(str(tmp_path / "store"))
    run = N.run_incremental(files, spark.read.parquet(str(tmp_path / "store")), [I.ROOT])
    plan = plan_of(run.results)
    assert r"[0-9]{3}-[0-9]{2}-[0-9]{4}" not in plan
    for exchanged in re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan):
        assert not re.search(r"\btext#", exchanged)
    assert run.artifacts.count() == 0
    assert {r.content for r in run.results.where("cached").collect()} == {"clean"}
