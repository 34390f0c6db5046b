"""Widths, canonical JSON and public addresses."""

import hashlib

from pyspark.sql import functions as F

from sparkloom.functions import exact


def test_widths(spark):
    rows = [("abc", 3, "abc   "), ("日本語", 6, "日本語"), ("日本語文", 8, "日本…  "[:4] + ""), ("éx", 2, "éx    "), ("", 0, "      "), ("abcdefgh", 8, "abcde…"), (None, None, None)]
    got = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "i int, t string").select("i", exact.width(F.col("t")).alias("w"), exact.fitted(F.col("t"), 6).alias("f")).orderBy("i").collect()
    assert [r["w"] for r in got] == [w for _, w, _ in rows]
    assert [r["f"] for r in got][:2] == ["abc   ", "日本語"] and got[2]["f"] == "日本… " and got[5]["f"] == "abcde…" and got[6]["f"] is None
    assert all(exact.cells(r["f"]) == 6 for r in got[:6])


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": [true, "é"]}', '{"a":[true,"\\u00e9"],"b":1}', "{", None]
    got = [r["d"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(exact.json_digest(F.col("t")).alias("d")).collect()]
    assert got[0] == got[1] == hashlib.sha256(b'{"a":[true,"\\u00e9"],"b":1}').hexdigest() and got[2:] == [None, None]


def test_public_hosts(spark):
    rows = [("a", "8.8.8.8"), ("a", "2001:4860:4860::8888"), ("b", "8.8.8.8"), ("b", "10.0.0.1"), ("c", "::1"), ("d", "no"), ("e", None)]
    got = {r["host"]: r["public"] for r in exact.public_hosts(spark.createDataFrame(rows, "host string, address string")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False}
