"""Findings: one pass over the texts, one text at a time; no join of a table with itself; the same matches as trying every rule."""

import re

import duckdb
import pytest

from sparkloom.functions import fixed
from sparkloom.functions.needles import longest, solid
from sparkloom.operators import scan, tree
from sparkloom.plans import catalogue, code
from sparkloom.plans.samples import sample


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["file_rule_hits", "file_findings"])
def test_texts_are_read_once(spark, sf_dir, name):
    plan = _plan(catalogue.queries()[name](spark, sf_dir))
    assert plan.count("MapInArrow") == 1
    assert "MapInPandas" not in plan
    assert "Join" not in plan


def test_repeated_ids_count_as_in_sql(spark, tmp_path):
    path = str(tmp_path)
    rows = [(i, f"text {i}\neval(input())\npassword") for i in (0, 1, 1, 2, 3, 413, 413)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    cursor = con.execute(catalogue.oracle_sql()["file_rule_hits"])
    columns = [d[0] for d in cursor.description]
    got = catalogue.queries()["file_rule_hits"](spark, path).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cursor.fetchall(), key=str)


def test_least_lengths_lose_no_match():
    for pattern in [*(r.pattern for r in code.RULES), *(p for _, p, _ in [*fixed.SECRETS, *fixed.RISKS])]:
        for m in re.finditer(pattern, sample(pattern)):
            assert longest(m[0]) >= solid(pattern), pattern
    assert solid(r"\b[5KL][1-9A-HJ-NP-Za-km-z]{50,51}\b") == 51
    assert solid(r"(?:ab|c)d?\s+\S{3,}") == 3
    assert solid(r"a[^b]c") == 1


def test_cut_trees_are_told(spark):
    rows = [("a", f"f{i}.py", "eval(x)") for i in range(4)] + [("b", "g.py", "eval(x)")]
    found = tree.findings(spark.createDataFrame(rows, "tree string, path string, body string"), keep=["tree"]).filter("rule like 'risk:%eval%'")
    kept = tree.ordered(found.dropDuplicates(["path"]), "tree", 3).collect()
    assert sorted((r["tree"], r["place"], r["truncated"]) for r in kept) == [("a", 1, True), ("a", 2, True), ("a", 3, True), ("b", 1, False)]


def test_findings_leave_in_pieces(spark):
    rows = spark.createDataFrame([("p", "eval(x)\n" * 2500)], "path string, body string")
    assert scan.findings(rows, "path", "body").count() == 2500
