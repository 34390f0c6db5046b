"""Evidence of documents equals its SQL on odd lines: other line ends, empty texts, wide spaces, repeated ids."""

import duckdb

from sparkloom.plans import catalogue

TEXTS = ["", "\n", "a\r\nb\r\nc", "a\x0bb\nc", "a\x85b c\nd\ne", " x \n　y \n z \n\tw\t\n", None, "é" * 150 + "\n" + "\U0001f600" * 250, "one\n\nthree\n\n"]
ROWS = [(5 * i + n, t) for i, t in enumerate(TEXTS) for n in range(5)] + [(1, "again\nb"), (2, "again\nb"), (2, "a\nb\n"), (-4, "x"), (None, "x")]


def test_evidence_equals_sql(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    cursor = con.execute(catalogue.oracle_sql()["doc_evidence"])
    columns = [d[0] for d in cursor.description]
    got = catalogue.queries()["doc_evidence"](spark, path).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cursor.fetchall(), key=str)
