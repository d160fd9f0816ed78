"""Every named query against its SQL twin."""
import duckdb
import pytest

import __spark_entry__ as entry
from veilspark.plans import catalog
from scripts.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    state, detail, _ = compare(spark, con, name, SF)
    assert state == "ok", detail


def test_entry(spark):
    df = entry.entry(spark)
    n = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    # the files of a run: documents, customer records, one memo per nation
    assert df.count() == n("documents") + n("customer") + n("nation") and "content" in df.columns
