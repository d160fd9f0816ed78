"""The rule table against the chain of patterns, and against every rule tried on every path."""
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.globs import glob_regex
from veilspark.operators import path_rules as R
from veilspark.operators import policy as Y

PATHS = ["/c/a.txt", "/c/docs/x.md", "/c/.env", "/c/.env.local", "/c/x/id_rsa", "/c/id_rsa.pub", "/c/k.pem", "/c/.ssh/known", "/c/.ssh", "/d/a.txt", "/c", "/cc/a",
         "/c/a/../.env", "/c//docs/./y", "/c/keychain/a/b", "/c/Library/Application Support/Firefox/p/q", "/c/b.tar.gz", "/c/x.pdf/y", None, "", "/", "c/rel.pdf", "/c/日本.docx"]


def test_equals_the_chain_on_the_given_rules(spark):
    files = spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(PATHS + PATHS[:4])], "id int, path string, key string, clean string")
    for roots in (["/c"], ["/c/docs", "/d/"], ["/"]):
        rules = R.rule_table(spark, roots, Y.DENY_GLOBS, Y.SANITIZE_GLOBS)
        got = R.path_policy_by_rules(files, rules)
        assert got.columns == [*files.columns, "path_reason", "path_verdict"]
        want = Y.path_policy(files, roots).where("path IS NOT NULL")
        pick = lambda df: {(r.id, r.path_reason, r.path_verdict) for r in df.collect()}
        assert pick(got.where("path IS NOT NULL")) == pick(want)
        assert [r.path_verdict for r in got.where("path IS NULL").collect()] == ["deny"]


def test_many_rules_equal_trying_all(spark):
    rng = random.Random(4)
    names = ["a", "bb", "x.pem", ".env", "id_rsa", "doc.tar.gz", "a+b", "q(1)", "日本"]
    parts = [*names, "*", "**", "*.pem", "id_*", "?", "a*", "*.tar.gz", "x**", "**y", "[z]"]
    globs = sorted({("/" if rng.random() < 0.6 else "") + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)})
    paths = sorted({"/" + "/".join(rng.choice([*names, "xy", "xa", "zy"]) for _ in range(rng.randint(1, 5))) for _ in range(300)})
    rules = spark.createDataFrame([(i, "deny", g) for i, g in enumerate(globs)] + [(0, "root", "/**"), (1, "deny", None)], "rank long, kind string, glob string")
    got = {r.path: r.path_reason for r in R.path_policy_by_rules(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    for p in paths:
        hit = next((g for g in globs if re.search(glob_regex(g), p)), None)
        assert got[p] == (Y.REASON_DENY.format(hit) if hit else Y.REASON_DEFAULT), p


def test_fifty_thousand_rules_touch_few_pairs(spark):
    rules = spark.range(50_000).select(F.col("id").alias("rank"), F.lit("deny").alias("kind"), F.format_string("/tenants/t%d/private/**", "id").alias("glob"))
    rules = rules.unionByName(spark.createDataFrame([(0, "root", "/tenants/**")], "rank long, kind string, glob string"))
    files = spark.range(2000).select(F.format_string("/tenants/t%d/%s/f.txt", F.col("id") * 7, F.when(F.col("id") % 2 == 0, "private").otherwise("open")).alias("path"))
    got = R.path_policy_by_rules(files, rules).groupBy("path_verdict").count().collect()
    assert {r.path_verdict: r["count"] for r in got} == {"deny": 1000, "sanitize": 1000}
    keys = rules.select(R.rule_key(F.col("glob")).alias("k")).groupBy("k").count().agg(F.max("count")).first()[0]
    assert keys == 1


@pytest.mark.parametrize("rows", [[], [(0, "root", "/**")]])
def test_no_rules_and_no_files(spark, rows):
    rules = spark.createDataFrame(rows, "rank long, kind string, glob string")
    files = spark.createDataFrame([("/a",)], "path string")
    assert R.path_policy_by_rules(files, rules).first().path_verdict == ("sanitize" if rows else "deny")
    assert R.path_policy_by_rules(files.limit(0), rules).count() == 0
