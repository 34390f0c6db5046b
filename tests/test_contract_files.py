"""Contract rules on whole files: nothing but findings is shuffled, each file stands for itself, and both ways agree."""

import duckdb

from sparkloom.operators import scan
from sparkloom.plans import catalogue, code


def test_only_findings_are_shuffled(spark, sf_dir):
    plan = catalogue.queries()["file_contracts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Aggregate") == 1


def test_repeated_ids_equal_sql(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(i, f"text {i}") for i in [*range(24), 4, 4, 7, 9]], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    cursor = con.execute(catalogue.oracle_sql()["file_contracts"])
    columns = [d[0] for d in cursor.description]
    got = catalogue.queries()["file_contracts"](spark, path).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cursor.fetchall(), key=str)


def test_lines_and_files_give_the_same(spark):
    rows = spark.createDataFrame([(f"src/C{i}.sol", b) for i, b in enumerate(code.CONTRACT_BODIES)] + [("n.sol", None), ("e.sol", "")], "path string, body string")
    of_lines = scan.contract_findings(scan.code_lines(rows, "path", "body")).collect()
    of_files = scan.contract_file_findings(rows, "path", "body").collect()
    assert of_lines and sorted(map(tuple, of_lines)) == sorted(map(tuple, of_files))
