"""Literal rows for what no oracle states."""

import hashlib
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from sparkloom.functions import fixed, text
from sparkloom.operators import drift, html, manifests, scan, state
from sparkloom.plans import web
from sparkloom.plans.catalogue import flagship, queries
from sparkloom.sources import trees

AWS = "AKIA" + "ABCDEFGHIJKLMNOP"


def test_flagship_and_every_query_without_oracle(spark, sf_dir):
    rows = flagship(spark, sf_dir).collect()
    assert len(rows) == 50 and rows == sorted(rows, key=lambda r: (r["score"], r["page_id"]))
    for name in ("page_markdown", "page_scrape", "lit_decisions"):
        assert queries()[name](spark, sf_dir).count() > 0


def test_decision_reasons(spark, sf_dir):
    got = {r["id"]: r["reason"] for r in queries()["lit_decisions"](spark, sf_dir).collect()}
    assert got == {1: "", 2: "choice", 3: "distribution_sum", 4: "distribution_labels", 5: "numeric_range", 6: "confidence_metric", 7: "", 8: "numeric_range"}


def test_findings_carry_place_mask_and_receipt(spark):
    rows = [("a.py", f"x = 1\nkey = '{AWS}'\neval(x)\n"), ("b.py", "AKIA" + "IOSFODNN7EXAMPLE"), ("c.py", None)]
    found = scan.findings(spark.createDataFrame(rows, "path string, body string"), "path", "body").collect()
    assert {(r["path"], r["rule"], r["line"], r["severity"]) for r in found} == {("a.py", "aws_key", 2, "critical"), ("a.py", "eval_use", 3, "medium")}
    for r in found:
        assert AWS not in r["snippet"] + r["detail"]
        assert r["snippet_sha256"] == hashlib.sha256(r["snippet"].encode()).hexdigest()
        assert r["receipt"] == "sha256:" + hashlib.sha256(f"{r['rule']}|{r['path']}|{r['line']}|{r['snippet_sha256']}".encode()).hexdigest()[:16]
    own = spark.createDataFrame(found)
    same = own.select(text.receipt(F.col("rule"), F.col("path"), F.col("line"), F.col("snippet_sha256")).alias("again"), "receipt")
    assert all(r["again"] == r["receipt"] for r in same.collect())
    report = trees.report(own).first()
    assert (report["critical"], report["medium"], report["gate"]) == (1, 1, "BLOCK")


def test_report_of_nothing(spark):
    r = trees.report(spark.createDataFrame([], scan.FINDING)).first()
    assert r["manifest_root"] == hashlib.sha256(b"").hexdigest() and r["gate"] == "PASS"


def test_page_reader():
    page = html.read_page("<html lang=en>before<title>T &amp; x</title><h2> A <b>b</b></h2><a href='/x'>go</a><a href=''>no<pre>" + "c" * 30 + "</pre><script type='application/ld+json'>{\"a\":1}</script><p style='opacity:0.5' class=k>t</p>")
    assert page["title"] == "before T & x".replace(" T", "T") and page["lang"] == "en"
    assert page["headings"] == [(2, "A b")] and page["links"] == [("/x", "go")]
    assert page["code_blocks"] == ["c" * 30] and page["json_ld"] == ['{"a":1}'] and page["hidden"] == ["<p> k"] and page["scripts"] == 1
    seen = html.read_page("<body><div hidden>secret<p>x</p></div><p>shown</p></body>", visible=True)
    assert seen["text_nodes"] == ["shown"] and "secret" not in seen["text"]
    assert html.read_page(None)["text"] == ""


def test_contract_rules_and_negative_control(spark, sf_dir):
    got = {(r["path"], r["rule"], r["line"], r["severity"]) for r in queries()["contract_rules"](spark, sf_dir).collect()}
    assert not [g for g in got if g[0] == "src/Good.sol"]
    assert ("src/Bad.sol", "unchecked_call", 4, "high") in got and ("src/Bad.sol", "tx_origin_auth", 3, "critical") in got
    assert ("test/Bad.t.sol", "public_initializer", 1, "high") in got


def test_dependencies(spark, sf_dir):
    got = {(r["path"], r["name"], r["version"]) for r in queries()["dep_parse"](spark, sf_dir).collect()}
    for want in [("r/requirements.txt", "flask", "2.0"), ("g/go.mod", "github.com/a/b", "1.2.3"), ("c/Cargo.toml", "tokio", "1.2"), ("p/package.json", "@a/b", "1.0"), ("m/pom.xml", "two", "*"), ("b/Gemfile", "puma", "*"), ("q/composer.json", "x/y", "1"), ("y/pubspec.yaml", "http", "1.0")]:
        assert want in got, want
    assert not [g for g in got if g[1] in ("z", "no", "php")] and len(got) == len(web.MANIFESTS) + 9
    many = spark.createDataFrame([("m", "pypi", "\n".join(f"p{i}==1" for i in range(90)))], "path string, eco string, body string")
    assert manifests.dependencies(many).count() == fixed.DEPS_EACH


def test_archives(spark):
    tar, zipped = io.BytesIO(), io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for name, body in (("w/a.py", b"x"), ("../evil", b"y"), ("w/node_modules/z.js", b"z")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        link = tarfile.TarInfo("w/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("b.txt", "hi")
        z.writestr("big.txt", "n" * 400_000)
    df = spark.createDataFrame([("t", bytearray(tar.getvalue())), ("z", bytearray(zipped.getvalue())), ("bad", bytearray(b"PKxx")), ("no", None)], "name string, body binary")
    assert {(r["archive"], r["path"]) for r in trees.members(df, "name", "body").collect()} == {("t", "w/a.py"), ("z", "b.txt")}


def test_tree_of_files(spark, tmp_path):
    for name in ("a.py", "sub/b.js", "node_modules/c.js", "d.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {r["path"] for r in trees.files(spark, str(tmp_path)).collect()} == {"a.py", "sub/b.js"}


def test_roots_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    roots = {drift.manifest_root(drift.manifest(docs.repartition(n), "doc_id", "text")).first()["root"] for n in (1, 5)}
    assert len(roots) == 1


def test_brace_depth_and_lines(spark):
    r = spark.createDataFrame([("}{ {} { { } }\r\nb\n",)], "t string").select(scan.brace_depth(F.col("t")).alias("d"), text.lines(F.col("t")).alias("l")).first()
    assert (r["d"], r["l"]) == (3, ["}{ {} { { } }", "b"])


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    from sparkloom.streaming import stateful

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.when(F.col("event_type") == "error", "throttled").otherwise("ok"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, stream, mode in (("cool", stateful.cooldown(source, "user_id", "ts", 21_600.0), "append"), ("limits", stateful.adaptive_limit(source, "user_id", "ts", "k"), "update"), ("tokens", stateful.once(source, "user_id", "ts", "90 days"), "append")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r["key"]: r["n"] for r in spark.sql("SELECT key, count_if(accepted) AS n FROM cool GROUP BY key").collect()}
    assert got == {str(r["user_id"]): r["accepted"] for r in state.cooldown(events, ["user_id"], "ts", "event_id", 21_600).collect()}
    limits = {r["key"]: r["limit"] for r in spark.sql("SELECT * FROM limits").collect()}
    assert limits == {str(r["user_id"]): r["limit"] for r in state.adaptive_limit(events, ["user_id"], ["ts", "event_id"], "k").collect()}
    assert spark.sql("SELECT * FROM tokens").count() == events.select("user_id").distinct().count()
