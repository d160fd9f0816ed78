"""The registered queries: names, columns, and SQL twins."""
import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check_oracles import TABLES, compare
from veilspark.llm import registry

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
                          "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op12_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op13_cross_tokenizer_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
                                       "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
}


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14)) and {*registry.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns(spark, name):
    df = entry.queries()[name](spark, SF)
    have = dict(df.dtypes)
    assert {c: have.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    rows = spark.read.parquet(f"{SF}/{'pages' if 'html' in name else 'documents'}.parquet").count()
    assert df.count() == rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    state, detail, _ = compare(spark, con, name, SF)
    assert state == "ok", detail
