"""Typed fields, schemas and imports on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import imports, typed
from sparkloom.plans.catalogue import queries


def test_extraction_quality_is_the_published_one(spark, sf_dir):
    r = queries()["typ_eval"](spark, sf_dir).first()
    assert (r["tp"], r["fp"], r["fn"], r["wrong_abstain"], r["precision"], r["recall"], r["abstention"]) == (7, 0, 1, 0, 1.0, 0.875, 1.0)


@pytest.mark.parametrize(
    "bad",
    [
        "", "[]", "{}", '{"a": {}}', '{"a": {"type": "date"}}', '{"1a": {"type": "string"}}', '{"a": {"type": "string"}, "a": {"type": "string"}}', '{"a": {"type": "string", "selector": "body"}}', '{"a": {"type": "string", "selector": "jsonld:1"}}',
        '{"a": {"type": "string", "hint": 3}}', '{"a": {"type": "string", "required": 1}}', '{"a": {"type": "string", "more": 1}}', json.dumps({f"f{i}": {"type": "string"} for i in range(17)}), '{"a": {"type": "string", "hint": "' + "x" * 241 + '"}}', " " * 9000,
    ],
)
def test_bad_schemas(bad):
    with pytest.raises(ValueError):
        typed.parse_schema(bad)


def test_values_need_their_own_evidence(spark):
    schema = json.dumps({k: {"type": t, "selector": s} for k, t, s in [("n", "number", "jsonld:n"), ("t", "string", "text"), ("l", "string[]", "links"), ("h", "string[]", "headings"), ("x", "number", "title")]})
    pages = ['<title>5</title><script type="application/ld+json">{"n": 12, "m": 3}</script><h1>A</h1><a href="/q">q</a>', '<script type="application/ld+json">{"n": "012"}</script>', "<p>a &amp; b</p>", None]
    got = [{f["field"]: f["value"] for f in r["fields"]} for r in typed.fields(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string"), schema).orderBy("i").collect()]
    assert got[0]["n"] == "12" and got[0]["l"] == '["/q"]' and got[0]["h"] == '["A"]' and got[0]["x"] == "5"
    assert got[1]["n"] is None and got[2]["t"] is None and set(got[3].values()) == {None}


def test_outcomes(spark):
    df = spark.createDataFrame([(200, True), (404, True), (402, True), (200, False)], "code int, may boolean").withColumn("html", F.lit("<title>t</title>"))
    rows = typed.extracted(df, '{"title": {"type": "string", "required": true}}', status=F.col("code"), allowed=F.col("may")).collect()
    assert [r["outcome"] for r in rows] == ["ok", "http_404", "payment_required", "access_denied"]
    assert [r["invalid"] for r in rows] == [[], ["title"], ["title"], ["title"]] and rows[1]["fields"][0]["method"] == "error"


def test_parsed_imports():
    body = "import os, a.b as c\nfrom . import x, y\nfrom .z import w\nfrom ..up import v\nfrom .... import far\nfrom q import *\nif 1:\n    import deep\n"
    assert imports.parsed_imports("p/q/m.py", body) == ["a.b", "deep", "os", "p.q", "p.q.z", "p.up", "q"]
    assert imports.parsed_imports("p/__init__.py", "from . import x") == ["p.__init__"] and imports.parsed_imports("m.py", "from . import x") == [] and imports.parsed_imports("a.py", "def") == []


def test_capture(spark):
    rows = [("a.py", "import os\nif __name__ == '__main__':\n    pass\n"), ("requirements.txt", "Flask_X==1\n# no\n-r b\nname"), ("package.json", '{"dependencies": {"@a/b": "1"}, "devDependencies": {"c": "2"}}'), ("b.js", "// from 'no'\nfrom 'yes'"), ("c.py", None)]
    got = {(r["kind"], r["key"]) for r in imports.capture(spark.createDataFrame(rows, "path string, body string")).collect()}
    assert got == {
        ("modules", "a.py"), ("modules", "requirements.txt"), ("modules", "package.json"), ("modules", "b.js"), ("imports", "a.py -> os"), ("imports", "b.js -> yes"), ("entrypoints", "a.py"),
        ("external_deps", "flask-x"), ("external_deps", "name"), ("external_deps", "@a/b"), ("external_deps", "c"),
    }


def test_normal_paths(spark):
    cases = {"a/../b": "b", "./a//b/.": "a/b", "../../a": "../../a", "a/..": ".", "a/b/../../..": ".."}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", imports.normal_path(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == cases
