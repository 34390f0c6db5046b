"""Old machines in messages: the text is folded once, however many words are looked for, and results equal the SQL."""

import duckdb

from sparkloom.plans import catalogue

TEXTS = ["bbs on a modem with a floppy", "FIDONET", "　crt bbs ", " dos bbs", "  ansi bbs  ", "", None, "snes", "nothing", "turbo button\n56K"]


def test_machines_equal_sql_and_fold_once(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    cursor = con.execute(catalogue.oracle_sql()["in_machines"])
    columns = [d[0] for d in cursor.description]
    df = catalogue.queries()["in_machines"](spark, path).select(*columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cursor.fetchall(), key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2  # the text, and the seed of its digest
