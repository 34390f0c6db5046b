"""Queries on what is taken in and refused. Every document stands for one case of a list, by its id."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed, text
from sparkloom.operators import intake, manifests, policy
from sparkloom.plans.documents import _literal
from sparkloom.plans.registry import query
from sparkloom.session import table
from sparkloom.sources import trees


def _cases_sql(rows: list[tuple], names: str) -> str:
    numbered = [(i, *row) for i, row in enumerate(rows)]
    return f"(SELECT doc_id, {names} FROM (SELECT doc_id FROM documents) JOIN (VALUES {_literal(numbered)}) AS c(k, {names}) ON doc_id % {len(rows)} = k)"


def _cases(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    few = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"k long, {schema}")
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(rows)).alias("k")).join(F.broadcast(few), "k").drop("k")


UPLOADS = [
    ("f1", "tree.zip", 100), ("f2", "a b-(1).TAR.GZ", 5), (None, "x.zip", 5), ("", "x.zip", 5), ("f3", None, 5), ("f4", "-bad.zip", 5), ("f5", "a/b.zip", 5), ("f6", "photo.png", 5), ("f7", "x.tgz", 15_000_001),
    ("f8", "x.tgz", 0), ("f9", "x.tgz", None), ("f10", "x" * 182 + ".zip", 5), ("f11", "x.tar", 9), ("f12", "ünï.zip", 9), ("f13", "x.zip", -4),
]
END_SQL = "CASE WHEN ends_with(lower(name), '.zip') THEN '.zip' WHEN ends_with(lower(name), '.tar.gz') THEN '.tar.gz' WHEN ends_with(lower(name), '.tgz') THEN '.tgz' ELSE '' END"


@query(f"""SELECT doc_id, CASE WHEN coalesce(file_id, '') = '' THEN 'no file id' WHEN NOT coalesce(regexp_matches(name, '{fixed.UPLOAD_NAME}'), false) THEN 'name' WHEN {END_SQL} = '' THEN 'format' WHEN size > 15000000 THEN 'too large' WHEN size <= 0 THEN 'empty' ELSE '' END AS reason,
  CASE WHEN {END_SQL} = '.zip' THEN 'zip' WHEN {END_SQL} <> '' THEN 'tgz' END AS kind, greatest(1, least(15000000, coalesce(size, 0)))::BIGINT AS cap FROM {_cases_sql(UPLOADS, 'file_id, name, size')}""")
def in_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, UPLOADS, "file_id string, name string, size long")
    return rows.select("doc_id", intake.upload_reason(F.col("file_id"), F.col("name"), F.col("size")).alias("reason"), intake.upload_kind(F.col("name")).alias("kind"), intake.download_cap(F.coalesce("size", F.lit(0))).alias("cap"))


HEADS = [("zip", "504B0304AA"), ("zip", "504B0506"), ("zip", "504B0102"), ("tgz", "1F8B08"), ("tgz", "504B0304"), ("zip", ""), ("zip", None), ("rar", "52617221"), ("tgz", "1F"), ("zip", "504B0708")]
SERVER_PATHS = ["documents/file_1.zip", "files/a", "photos/a.jpg", "documents/../x", "/documents/a", "documents/a.b.c", "files/" + "a" * 65, "documents/é", None, "documents/a.tarball12", "documents/a.zip"]


@query(f"""SELECT doc_id, coalesce(CASE kind WHEN 'zip' THEN left(head, 8) IN ('504B0304', '504B0506', '504B0708') WHEN 'tgz' THEN starts_with(head, '1F8B') END, false) AS fits,
  coalesce(length(path) <= 96 AND regexp_matches(path, '{fixed.SERVER_PATH}'), false) AS safe FROM {_cases_sql(HEADS, 'kind, head')} JOIN {_cases_sql([(p,) for p in SERVER_PATHS], 'path')} USING (doc_id)""")
def in_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, HEADS, "kind string, head string").join(_cases(spark, sf_dir, [(p,) for p in SERVER_PATHS], "path string"), "doc_id")
    return rows.select("doc_id", intake.is_archive(F.col("kind"), F.unhex("head")).alias("fits"), intake.is_server_path(F.col("path")).alias("safe"))


ADDRESSES = [
    "https://github.com/a/b", " https://GitHub.com/a/b.git ", "http://github.com/a/b", "https://gitlab.com/a/b", "https://github.com/a", "https://github.com/a/b/c", "https://u@github.com/a/b", "https://github.com:443/a/b",
    "https://github.com/a/b?x=1", "https://github.com/a/b#r", "", None, "https://github.com/a b/c", "https://github.com//a//b/", "https://github.com/a/" + "b" * 2050, "github.com/a/b", "https://github.com/a/.git",
    "https://example.org/x", "https://example.org/x y", "https://10.0.0.1/", "http://localhost/", "https://example.org:8443/", "https://example.org/?q", "ftp://example.org/", "https://a.localhost./",
]
BRANCHES = ["main", "feature/x-1.2", "a..b", "", None, "é", "a b", "v1.0_x"]
U = "trim(coalesce(address, ''))"
PARTS_SQL = f"""(SELECT doc_id, address, branch, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc, list_filter(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps
  FROM (SELECT doc_id, address, branch, {U} AS u FROM {_cases_sql([(a,) for a in ADDRESSES], 'address')} JOIN {_cases_sql([(b,) for b in BRANCHES], 'branch')} USING (doc_id)))"""
REPO_SQL = f"""CASE WHEN u = '' THEN 'empty' WHEN length(u) > 2048 THEN 'too long' WHEN scheme <> 'https' THEN 'scheme' WHEN lower(regexp_extract(netloc, '^(?:.*@)?([^:]*)', 1)) <> 'github.com' THEN 'host' WHEN contains(netloc, '@') OR contains(netloc, ':') OR contains(u, '?') OR contains(u, '#') THEN 'not bare'
  WHEN len(steps) <> 2 THEN 'path' WHEN NOT (regexp_matches(steps[1], '{fixed.REPOSITORY_NAME}') AND regexp_matches(regexp_replace(steps[2], '\\.git$', ''), '{fixed.REPOSITORY_NAME}')) THEN 'name' ELSE '' END"""


@query(f"""SELECT doc_id, reason, CASE WHEN reason = '' THEN steps[1] END AS owner, CASE WHEN reason = '' THEN regexp_replace(steps[2], '\\.git$', '') END AS name, coalesce(regexp_matches(branch, '{fixed.BRANCH_NAME}') AND NOT contains(branch, '..'), false) AS branch_ok,
  coalesce(length(address) <= 2048 AND NOT regexp_matches(address, '\\s') AND regexp_matches(address, '^https?://') AND NOT contains(netloc, '@') AND NOT regexp_matches(address, '\\?.') AND NOT regexp_matches(address, '#.') AND (NOT contains(netloc, ':') OR (scheme = 'https' AND ends_with(netloc, ':443')))
    AND NOT regexp_matches(lower(netloc), '^(10\\.|127\\.|192\\.168\\.)') AND NOT regexp_matches(lower(netloc), '(^|\\.)localhost\\.?$'), false) AS public FROM (SELECT *, {REPO_SQL} AS reason FROM {PARTS_SQL})""")
def in_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, [(a,) for a in ADDRESSES], "address string").join(_cases(spark, sf_dir, [(b,) for b in BRANCHES], "branch string"), "doc_id")
    repo = intake.repository(F.col("address"))
    return rows.select("doc_id", repo["reason"].alias("reason"), repo["owner"].alias("owner"), repo["name"].alias("name"), intake.is_branch(F.col("branch")).alias("branch_ok"), intake.is_public(F.col("address")).alias("public"))


LISTS = ["1, 2;3  4", "*", "* 7", "", None, " , ", "1,x", "-5", "1.5", "12345678901"]
TYPES = ["text/html; charset=utf-8", "TEXT/PLAIN", "", None, "application/json", "application/xhtml+xml", "image/png"]
CRAWLED = ["/a/b", "", None, "/a%20b", "/a%2520b", "/a%25252520b", "/a%2525252520b", "/a//b", "/a/../b", "/%2e%2e/x", "/a\\b", "/100%", "/a+b%2Bc", "/%E2%82%AC"]
PARTS = "list_filter(regexp_split_to_array(trim(coalesce(v, '')), '[,\\s;]+'), lambda x: x <> '')"


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(named, lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL AND true), ',') AS ids, list_contains(parts, '*') AS open, len(list_filter(named, lambda x: NOT regexp_matches(x, '^[+-]?[0-9]+$'))) > 0 AS bad,
  coalesce(t, '') = '' OR regexp_matches(lower(t), 'text/html|application/xhtml|text/plain') AS page FROM (SELECT doc_id, t, {PARTS} AS parts, list_filter({PARTS}, lambda x: x <> '*' AND regexp_matches(x, '^[+-]?[0-9]+$') OR x NOT IN ('*')) AS named0, list_filter({PARTS}, lambda x: x <> '*') AS named
    FROM {_cases_sql([(v,) for v in LISTS], 'v')} JOIN {_cases_sql([(t,) for t in TYPES], 't')} USING (doc_id))""".replace("list_filter(list_transform(named, lambda x: TRY_CAST(x AS BIGINT))", "list_filter(list_transform(list_filter(named, lambda y: regexp_matches(y, '^[+-]?[0-9]+$')), lambda x: TRY_CAST(x AS BIGINT))"))
def in_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, [(v,) for v in LISTS], "v string").join(_cases(spark, sf_dir, [(t,) for t in TYPES], "t string"), "doc_id")
    found = intake.ids(F.col("v"))
    return rows.select("doc_id", F.array_join(F.transform(found["ids"], lambda x: x.cast("string")), ",").alias("ids"), found["open"].alias("open"), found["bad"].alias("bad"), intake.is_page_type(F.col("t")).alias("page"))


UNCLEAR = "(contains({p}, '//') OR contains({p}, chr(92)) OR len(list_filter(string_split({p}, '/'), lambda s: s IN ('.', '..'))) > 0)"


@query(f"""WITH f AS (SELECT doc_id, CASE WHEN coalesce(path, '') = '' THEN '/' ELSE path END AS p0 FROM {_cases_sql([(p,) for p in CRAWLED], 'path')}), g AS (SELECT doc_id, p0, url_decode(regexp_replace(p0, '%([^0-9A-Fa-f]|.?$|[0-9A-Fa-f][^0-9A-Fa-f])', '%25\\1')) AS p1 FROM f),
  h AS (SELECT *, url_decode(regexp_replace(p1, '%([^0-9A-Fa-f]|.?$|[0-9A-Fa-f][^0-9A-Fa-f])', '%25\\1')) AS p2 FROM g), i AS (SELECT *, url_decode(regexp_replace(p2, '%([^0-9A-Fa-f]|.?$|[0-9A-Fa-f][^0-9A-Fa-f])', '%25\\1')) AS p3 FROM h), j AS (SELECT *, url_decode(regexp_replace(p3, '%([^0-9A-Fa-f]|.?$|[0-9A-Fa-f][^0-9A-Fa-f])', '%25\\1')) AS p4 FROM i)
  SELECT doc_id, CASE WHEN p3 <> p4 OR {UNCLEAR.format(p='p0')} OR {UNCLEAR.format(p='p1')} OR {UNCLEAR.format(p='p2')} OR {UNCLEAR.format(p='p3')} THEN NULL ELSE array_to_string(list_distinct_ordered, ' ') END AS forms
  FROM (SELECT *, CASE WHEN p0 = p1 THEN [p0] WHEN p1 = p2 THEN [p0, p1] WHEN p2 = p3 THEN [p0, p1, p2] ELSE [p0, p1, p2, p3] END AS list_distinct_ordered FROM j)""")
def in_crawl_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, [(p,) for p in CRAWLED], "path string").select("doc_id", F.array_join(intake.crawl_paths(F.col("path")), " ").alias("forms"))


MESSAGES = [
    ("/map@Helper https://x", False, False), ("/map@other x", False, False), ("/map@helper", True, False), ("hi @HELPER there", False, False), ("hi @helper", True, False), ("no", False, True), ("no", True, True), ("", False, False), (None, False, None), ("@helper", False, False),
    ("my old modem and a floppy", False, False), ("the BBS sysop had a joystick", False, False),
]


def _groups_sql() -> str:
    return "[" + ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN {i} END" for i, words in enumerate(fixed.OLD_MACHINES)) + "]"


@query(f"""SELECT doc_id, (starts_with(head, '/') AND lower(regexp_extract(head, '@(.*)$', 1)) = 'helper') OR (NOT coalesce(is_bot, false) AND (coalesce(reply, false) OR contains(low, '@helper'))) AS addressed, CASE WHEN bare = '' THEN text ELSE bare END AS bare,
  CASE WHEN len(hits) > 0 THEN hits[1 + ('0x' || left(sha256(lower(trim(text))), 2))::INT % len(hits)] END AS machine FROM (SELECT *, list_filter({_groups_sql()}, lambda x: x IS NOT NULL) AS hits FROM (
    SELECT doc_id, text, is_bot, reply, regexp_extract(trim(coalesce(text, '')), '^(\\S+)', 1) AS head, lower(coalesce(text, '')) AS low, trim(regexp_replace(text, '(?i)@helper\\b', ' ', 'g')) AS bare FROM {_cases_sql(MESSAGES, 'text, is_bot, reply')}))""")
def in_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = _cases(spark, sf_dir, MESSAGES, "text string, is_bot boolean, reply boolean")
    return rows.select("doc_id", intake.is_addressed(t, "helper", F.col("is_bot"), F.col("reply")).alias("addressed"), intake.unmentioned(t, "helper").alias("bare"), intake.remembered(t).alias("machine"))


@query(f"SELECT doc_id, len(hits)::INT > 0 AS named, CASE WHEN len(hits) > 0 THEN hits[1 + ('0x' || left(sha256(lower(trim(text))), 2))::INT % len(hits)] END AS machine FROM (SELECT doc_id, text, list_filter({_groups_sql()}, lambda x: x IS NOT NULL) AS hits FROM (SELECT doc_id, text, lower(text) AS low FROM documents))")
def in_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", intake.remembered(F.col("text")).alias("machine"))
    return rows.select("doc_id", F.col("machine").isNotNull().alias("named"), "machine")


def _terms(*offers: dict) -> str:
    return json.dumps({"x402Version": 1, "accepts": list(offers)})


NETWORKS = ("eip155:8453", "eip155:84532")
CHALLENGES = [
    (None, _terms({"scheme": "exact", "network": NETWORKS[0], "maxAmountRequired": "9", "payTo": "a"}, {"scheme": "exact", "network": NETWORKS[1], "amount": 7, "payTo": "b"}, {"network": NETWORKS[1], "amount": 7, "payTo": "c"})),
    (base64.b64encode(_terms({"scheme": "exact", "network": NETWORKS[0], "amount": "5", "payTo": "h"}).encode()).decode(), _terms({"network": NETWORKS[0], "amount": "1", "payTo": "body"})),
    (_terms({"scheme": "upto", "network": NETWORKS[0], "amount": "1", "payTo": "x"}, {"network": NETWORKS[0], "max_amount_required": "30", "payTo": "y"}), None), (None, "{}"), (None, None), ("not json", _terms({"network": "other", "amount": "1", "payTo": "z"})),
]
TERMS_SQL = "CASE WHEN json_valid(head) AND head IS NOT NULL THEN head WHEN head IS NOT NULL AND json_valid(coalesce(TRY(decode(from_base64(head))), 'x')) THEN decode(from_base64(head)) WHEN json_valid(body) AND json_extract(body, '$.accepts') IS NOT NULL THEN body END"


@query(f"""WITH c AS (SELECT doc_id, {TERMS_SQL} AS terms FROM {_cases_sql(CHALLENGES, 'head, body')}), o AS (SELECT doc_id, unnest(from_json(json_extract(terms, '$.accepts'), '["JSON"]')) AS o, unnest(range(json_array_length(json_extract(terms, '$.accepts'))::INT)) AS i FROM c WHERE terms IS NOT NULL),
  a AS (SELECT doc_id, i, o->>'network' AS network, coalesce(o->>'maxAmountRequired', o->>'amount', o->>'max_amount_required')::BIGINT AS amount, o->>'payTo' AS pay_to FROM o WHERE coalesce(o->>'scheme', 'exact') = 'exact' AND o->>'network' IN {NETWORKS}),
  b AS (SELECT doc_id, arg_min(network, (amount, i)) AS network, min(amount) AS amount, arg_min(pay_to, (amount, i)) AS pay_to FROM a GROUP BY doc_id) SELECT c.doc_id, network, amount, pay_to FROM c LEFT JOIN b USING (doc_id)""")
def in_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, CHALLENGES, "head string, body string")
    headers = F.when(F.col("head").isNotNull(), F.create_map(F.lit("X-Payment-Required"), F.col("head"))).otherwise(F.create_map(F.lit("Via"), F.lit("x")))
    best = intake.cheapest_offer(headers, F.col("body"), NETWORKS)
    return rows.select("doc_id", best["network"].alias("network"), best["amount"].cast("long").alias("amount"), best["pay_to"].alias("pay_to"))


WATCHES = [(False, True, None, 0, 0, False), (True, False, None, 0, 0, False), (True, True, False, 1, 2, True), (True, True, True, 0, 0, False), (True, True, None, 1, 3, False), (True, True, True, 0, 3, False), (True, True, True, 2, 3, True)]


@query(f"""SELECT doc_id, status, CASE WHEN status IN ('error', 'baseline-refused') THEN 2 WHEN status <> 'drift' THEN 0 WHEN breaking > 0 THEN 1 ELSE 3 END AS code FROM (SELECT doc_id, breaking, CASE WHEN NOT there THEN 'baseline-established' WHEN NOT readable THEN 'error' WHEN signed IS NOT NULL AND NOT signed THEN 'baseline-refused'
  WHEN changes = 0 THEN 'clean' WHEN adopt THEN 'adopted' ELSE 'drift' END AS status FROM {_cases_sql(WATCHES, 'there, readable, signed, breaking, changes, adopt')})""")
def in_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, WATCHES, "there boolean, readable boolean, signed boolean, breaking long, changes long, adopt boolean")
    found = intake.watch_outcome(F.col("there"), F.col("readable"), F.col("signed"), F.col("breaking"), F.col("changes"), F.col("adopt"))
    return rows.select("doc_id", found["status"].alias("status"), found["exit"].alias("code"))


ODDMENTS = [("high", "secret:jwt", "Agent/1.0", "/a", "/a/b", "0.5"), ("CRITICAL", "risk:AUTH_off", "x\ty\x01z", "/a/", "/ab", "nan"), ("medium", "secret:x", "a\nb", "/a", "/a", "true"), (None, None, None, "/a", "/", "1e0"), ("high", "risk:eval_use", "u" * 300, "/r/", "/r/x/", "-0.1")]


@query(f"""SELECT doc_id, lower(coalesce(severity, '')) IN ('high', 'critical') AND regexp_matches(lower(coalesce(rule, '')), '{'|'.join(fixed.SEALING_HINTS)}') AS blocks, CASE WHEN NOT regexp_matches(coalesce(ua, ''), '[\\r\\n]') THEN left(regexp_replace(coalesce(ua, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), 256) END AS agent,
  path = rtrim(root, '/') OR starts_with(path, concat(rtrim(root, '/'), '/')) AS inside, lower(n) NOT IN ('true', 'false', 'nan') AND coalesce(TRY_CAST(n AS DOUBLE) BETWEEN 0 AND 1, false) AS in_range FROM {_cases_sql(ODDMENTS, 'severity, rule, ua, root, path, n')}""")
def in_oddments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, ODDMENTS, "severity string, rule string, ua string, root string, path string, n string")
    return rows.select("doc_id", intake.blocks_sealing(F.col("severity"), F.col("rule")).alias("blocks"), intake.agent(F.col("ua")).alias("agent"), intake.is_inside(F.col("root"), F.col("path")).alias("inside"), intake.in_range(F.col("n"), 0.0, 1.0).alias("in_range"))


#: One manifest of each kind, and how many lines of the plain ones are repeated.
FILES = [
    ("requirements.txt", "pypi", "flask==2.0\nrequests>=2.1 # c\n-r x\nname\nnumpy ~= 1.2; x\n" + "".join(f"p{i}==1.{i}\n" for i in range(30))), ("go.mod", "go", "module x\nrequire github.com/a/b v1.2.3\nrequire (\n\tgithub.com/c/d v0.1.0\n)\n"),
    ("Cargo.toml", "cargo", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = [] }\n# no = "1"\n[dev-dependencies]\nrand = "0.8"\n[other]\nz = "9"'),
    ("package.json", "npm", '{"dependencies": {"@a/b": "1.0", "c": "*"}, "devDependencies": {"d": "2"}, "scripts": {"x": "y"}}'), ("package.json", "npm", "{broken"), ("pom.xml", "maven", "<artifactId>one</artifactId><version>1</version><artifactId> two</artifactId>"),
    ("Gemfile", "rubygems", "gem 'rails', '7.0'\ngem \"puma\"\n# gem 'no'\n"), ("composer.json", "composer", '{"require": {"php": "8", "x/y": "1"}, "require-dev": {"t/u": "2"}}'), ("pubspec.yaml", "pub", "name: x\ndependencies:\n  http: ^1.0\n  path: 2.0\nother:\n  no: 1\n"),
    ("build.gradle", "gradle", "implementation 'a.b:c:1.0'\n  testImplementation(\"d:e:2\")\nfoo 'x:y:1'\n"), ("packages.config", "nuget", '<PackageReference Include="N" Version="3.1" />\n<PackageReference Version="1" Include="M" />\n'), ("Project.toml", "julia", 'name = "x"\nversion = "1"\nA = "0.1"\nB="2"\n'), ("x.bin", "unknown", "a==1"),
]
PARSER_SQL = "CASE eco " + " ".join(f"WHEN '{e}' THEN '{p}'" for e, p in fixed.PARSERS.items()) + " END"


def _named_sql(group: int) -> str:
    return "CASE parser " + " ".join(f"WHEN '{k}' THEN regexp_extract(raw, '{p.replace(chr(39), chr(39) * 2)}', {group})" for k, p in fixed.DEP_LINES.items() if group < 3 or k == "cargo") + " ELSE '' END"


def _sections_sql(parser: str, sections: list[str]) -> str:
    keys = "[" + ", ".join(f"'{s}'" for s in sections) + "]"
    return f"""SELECT path, eco, 1000000 * s + pos AS ord, k AS name, body::JSON->sec->>k AS version FROM (SELECT path, eco, body, sec, s, unnest(ks) AS k, unnest(range(len(ks))) AS pos FROM (SELECT path, eco, body, sec, s, coalesce(json_keys(body::JSON->sec), []) AS ks
      FROM (SELECT path, eco, body, unnest({keys}) AS sec, unnest(range({len(sections)})) AS s FROM f WHERE parser = '{parser}' AND json_valid(body))))"""


def dependencies_sql(rows: str) -> str:
    """Dependencies of manifests (path, eco, body)."""
    return f"""WITH f AS (SELECT path, eco, body, {PARSER_SQL} AS parser FROM {rows}),
  r AS (SELECT path, eco, parser, pos, CASE WHEN parser = 'go' AND starts_with(trim(ls[pos]), 'require') THEN trim(regexp_replace(trim(ls[pos]), '^[require]+', '')) ELSE ls[pos] END AS raw FROM (SELECT path, eco, parser, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT *, string_split(rtrim(body, chr(10)), chr(10)) AS ls FROM f WHERE parser IN {tuple(fixed.DEP_LINES)}))),
  s AS (SELECT *, last_value(CASE WHEN parser = 'cargo' AND regexp_matches(trim(raw), '^\\[.*\\]$') THEN lower(regexp_replace(trim(raw), '[\\[\\] ]', '', 'g')) WHEN parser = 'pub' AND regexp_matches(raw, '^[a-zA-Z_]+:') THEN regexp_extract(raw, '^([a-zA-Z_]+):', 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY pos) AS section FROM r),
  n AS (SELECT path, eco, parser, pos AS ord, {_named_sql(1)} AS name, CASE WHEN {_named_sql(2)} <> '' THEN {_named_sql(2)} ELSE {_named_sql(3)} END AS v FROM s WHERE CASE parser WHEN 'cargo' THEN section IN ('dependencies', 'dev-dependencies', 'build-dependencies') AND NOT starts_with(trim(raw), '#') WHEN 'pub' THEN section IN ('dependencies', 'dev_dependencies') ELSE true END),
  d AS (SELECT path, eco, ord, name, CASE WHEN v = '' THEN '*' ELSE v END AS version FROM n WHERE name <> '' AND NOT (parser = 'toml' AND name IN ('name', 'version', 'description', 'edition')) UNION ALL {_sections_sql('npm', ['dependencies', 'devDependencies', 'peerDependencies', 'optionalDependencies'])}
    UNION ALL SELECT * FROM ({_sections_sql('composer', ['require', 'require-dev'])}) WHERE name <> 'php' UNION ALL SELECT path, eco, pos, a[pos], coalesce(v[pos], '*') FROM (SELECT path, eco, a, v, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT path, eco, regexp_extract_all(body, '<artifactId>\\s*([^<]+)\\s*</artifactId>', 1) AS a, regexp_extract_all(body, '<version>\\s*([^<]+)\\s*</version>', 1) AS v FROM f WHERE parser = 'pom')))
  SELECT path, eco, name, version FROM d QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord, name) <= {fixed.DEPS_EACH}"""


@query(dependencies_sql(f"(SELECT concat(doc_id, '/', name) AS path, eco, body FROM {_cases_sql(FILES, 'name, eco, body')})"))
def dep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of a manifest for each document."""
    rows = _cases(spark, sf_dir, FILES, "name string, eco string, body string")
    return manifests.dependencies(rows.select(F.concat_ws("/", F.col("doc_id").cast("string"), "name").alias("path"), "eco", "body"))


@query(f"""SELECT eco, name, version FROM (SELECT DISTINCT eco, name, version FROM (VALUES {_literal([('npm', '@a/b', '1.0'), ('npm', 'c', '*'), ('npm', 'd', '2'), ('composer', 'x/y', '1'), ('composer', 't/u', '2'), ('maven', 'one', '1'), ('maven', 'two', '*')])}) AS v(eco, name, version)) ORDER BY ALL LIMIT 400""")
def dep_sbom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of all JSON and XML manifests: each dependency once, in order."""
    return manifests.sbom(dep_files(spark, sf_dir).filter("eco in ('npm', 'composer', 'maven')"))


MEMBERS = ["w/a.py", "../evil", "/abs", "a\\b", "C:x", "", "a/../b", "a/..b", "w/.hidden", "a//b", None]
MAPS = [
    "<urlset><url><loc>https://x/a</loc></url><url><loc> http://x/b?c=1&amp;d=2 </loc></url><loc>ftp://x/c</loc></urlset>", '<?xml version="1.0"?><s:sitemapindex xmlns:s="u"><s:LOC>https://x/m.xml</s:LOC></s:sitemapindex>', "<!DOCTYPE x [<!ENTITY a 'b'>]><loc>https://x/</loc>", "<loc>https://x/" + "y" * 2050 + "</loc>", "no xml", "",
]


@query(f"""SELECT doc_id, coalesce(path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, chr(92)) AND NOT regexp_matches(path, '^[A-Za-z]:') AND NOT list_contains(string_split(path, '/'), '..'), false) AS safe,
  CASE WHEN regexp_matches(xml, '(?i)<!ENTITY|<!DOCTYPE') THEN '' ELSE array_to_string(list_filter(list_transform(regexp_extract_all(xml, '(?is)<(?:\\w+:)?loc>\\s*([^<\\s]+)\\s*</(?:\\w+:)?loc>', 1), lambda u: replace(u, '&amp;', '&')), lambda u: regexp_matches(u, '^https?://') AND length(u) <= 2048), ' ') END AS locations,
  CASE WHEN doc_id % 20 >= 9 THEN 'critical' WHEN doc_id % 20 >= 7 THEN 'high' WHEN doc_id % 20 >= 5 THEN 'medium' ELSE 'low' END AS severity FROM {_cases_sql([(p,) for p in MEMBERS], 'path')} JOIN {_cases_sql([(x,) for x in MAPS], 'xml')} USING (doc_id)""")
def in_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of archive members, locations of site maps, and the other scale of severities."""
    rows = _cases(spark, sf_dir, [(p,) for p in MEMBERS], "path string").join(_cases(spark, sf_dir, [(x,) for x in MAPS], "xml string"), "doc_id")
    return rows.select("doc_id", F.coalesce(trees.safe_member(F.col("path")), F.lit(False)).alias("safe"), F.array_join(policy.sitemap_locations(F.col("xml")), " ").alias("locations"), text.severity_node(F.col("doc_id") % 20).alias("severity"))
