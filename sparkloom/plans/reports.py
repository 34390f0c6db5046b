"""Queries on reports, events and replies. Findings are made of the labelled documents, pages are those of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed, url
from sparkloom.operators import html, reports, trust
from sparkloom.plans.documents import _literal
from sparkloom.plans.intake import _cases, _cases_sql
from sparkloom.plans.registry import query
from sparkloom.plans.web import _visible_sql
from sparkloom.session import table

RULES = ["risk:eval_use", "secret:jwt", "risk:http_plaintext", "risk:sql_concat", "supply:verification_disabled"]
FINDINGS_SQL = f"""(SELECT concat('t', doc_id % 3) AS tree, {RULES}[1 + doc_id % 5] AS rule, {list(fixed.SEVERITIES)}[1 + doc_id * 7 % 5] AS severity, concat(source, '/', lang, '.py') AS path, (doc_id * 13 % 89)::INT AS line, left(lang, 1) AS detail FROM documents)"""
LANGUAGES_SQL = "(SELECT concat('t', doc_id % 3) AS tree, lang AS language, count(*) AS files FROM documents GROUP BY 1, 2)"


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at % len(items) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").withColumn("tree", F.concat(F.lit("t"), (d % 3).cast("string")))
    rows = docs.select("tree", pick(RULES, d).alias("rule"), pick(fixed.SEVERITIES, d * 7).alias("severity"), F.concat("source", F.lit("/"), "lang", F.lit(".py")).alias("path"), (d * 13 % 89).cast("int").alias("line"), F.left("lang", F.lit(1)).alias("detail"))
    return rows, docs.groupBy("tree", F.col("lang").alias("language")).agg(F.count("*").alias("files"))


@query(f"SELECT tree, rule, count(*)::BIGINT AS n, arg_min(concat(path, ':', line), (path, line)) AS example FROM {FINDINGS_SQL} WHERE severity = 'medium' GROUP BY tree, rule")
def rpt_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.medium_by_rule(_findings(spark, sf_dir)[0], ["tree"])


@query(f"""WITH f AS {FINDINGS_SQL}, c AS (SELECT tree, count(*) FILTER (severity = 'critical') AS cr, count(*) FILTER (severity = 'high') AS hi, count(*) FILTER (severity = 'medium') AS me, count(*) FILTER (severity = 'low') AS lo FROM f GROUP BY tree),
  w AS (SELECT tree, string_agg(concat('| ', severity, ' | ', rule, ' | `', path, ':', line, '` | ', detail, ' |'), chr(10) ORDER BY n) AS t FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY severity, path, line, rule) AS n FROM f WHERE severity IN ('critical', 'high')) WHERE n <= 60 GROUP BY tree),
  m AS (SELECT tree, string_agg(concat('- **', rule, '** ×', n, ' — e.g. `', example, '`'), chr(10) ORDER BY n DESC, rule) AS t FROM (SELECT tree, rule, count(*) AS n, arg_min(concat(path, ':', line), (path, line)) AS example FROM f WHERE severity = 'medium' GROUP BY tree, rule) GROUP BY tree),
  l AS (SELECT tree, string_agg(concat('- `', language, '`: ', files), chr(10) ORDER BY files DESC, language) AS t FROM {LANGUAGES_SQL} GROUP BY tree)
  SELECT c.tree, concat('# CODE AUDIT', chr(10), chr(10), '## Verdict', chr(10), '- gate: **', CASE WHEN cr > 0 THEN 'BLOCK' WHEN hi + me > 0 THEN 'REVIEW' ELSE 'PASS' END, '**', chr(10), '- findings: critical **', cr, '** · high **', hi, '** · medium **', me, '** · low **', lo, '**',
    chr(10), chr(10), '## Language mix', chr(10), l.t, chr(10), chr(10), '## Critical / High', chr(10), '| sev | kind | file:line | detail |', chr(10), '|---|---|---|---|', chr(10), w.t, chr(10), chr(10), '## Medium', chr(10), m.t) AS report FROM c JOIN w USING (tree) JOIN m USING (tree) JOIN l USING (tree)""")
def rpt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, mix = _findings(spark, sf_dir)
    return reports.audit_markdown(found, mix, "tree")


@query(f"""WITH p AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS place, regexp_replace(url, '^https?://', '') AS u, len(list_filter(string_split({_visible_sql('html')}, ' '), lambda x: x <> '')) AS words, CASE WHEN starts_with(url, 'https:') THEN 100 ELSE 85 END - 20 * (page_id % 3)::INT AS score FROM pages),
  v AS (SELECT *, CASE WHEN length(u) <= 64 THEN u ELSE left(u, 63) || '…' END AS s, CASE WHEN score >= 85 THEN 'TRUSTED' WHEN score >= 60 THEN 'CAUTION' ELSE 'HOSTILE' END AS verdict FROM p)
  SELECT concat('# SITE REPORT', chr(10), chr(10), '## Pages (', (SELECT count(*) FROM v), ')', chr(10), '| # | URL | words | trust | flags |', chr(10), '|---|---|---|---|---|', chr(10), (SELECT string_agg(concat('| ', place + 1, ' | `', s, '` | ', words, ' | ', score, ' ', verdict, ' | ', CASE WHEN page_id % 3 > 0 THEN 'low' ELSE '—' END, ' |'), chr(10) ORDER BY place) FROM v WHERE place < 200),
    chr(10), chr(10), '## Trust', chr(10), '- clean: ', (SELECT count(*) FROM v WHERE verdict = 'TRUSTED'), ' · flagged: **', (SELECT count(*) FROM v WHERE verdict <> 'TRUSTED'), '**', chr(10),
    (SELECT string_agg(concat('- `', s, '` → **', verdict, '** (', score, ')', CASE WHEN page_id % 3 > 0 THEN concat(chr(10), '  - low') ELSE '' END), chr(10) ORDER BY place) FROM (SELECT * FROM v WHERE verdict <> 'TRUSTED' ORDER BY place LIMIT 15))) AS report""")
def rpt_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    score = F.when(url.scheme(F.col("url")) == "https", 100).otherwise(85) - (page % 3 * 20).cast("int")
    words = F.size(F.filter(F.split(html.visible_text(F.col("html")), " "), lambda x: x != ""))
    rows = table(spark, sf_dir, "pages").select(page, "url", words.alias("words"), score.alias("score"), F.when(page % 3 > 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    place = F.row_number().over(reports.Window.orderBy("page_id")) - 1
    return reports.crawl_markdown(rows.withColumn("place", place).withColumn("verdict", trust.verdict(F.col("score"))))


MODULES_SQL = "(SELECT concat(source, '/', lang, doc_id % 40, '&.py') AS path, CASE WHEN doc_id % 11 = 0 THEN 'module_modified' WHEN doc_id % 13 = 0 THEN 'module_removed' END AS kind FROM documents)"
CELLS_SQL = f"""(SELECT path, kind, ((row_number() OVER (ORDER BY path) - 1) % 24 * 44 + 24)::BIGINT AS x, ((row_number() OVER (ORDER BY path) - 1) // 24 * 32 + 130)::BIGINT AS y FROM (SELECT path, max(kind) AS kind FROM {MODULES_SQL} GROUP BY path))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang", (d % 40).cast("string"), F.lit("&.py")).alias("path"), F.when(d % 11 == 0, "module_modified").when(d % 13 == 0, "module_removed").alias("kind"))
    changes = rows.groupBy("path").agg(F.max("kind").alias("kind")).filter("kind is not null").select(F.col("path").alias("target"), "kind")
    there = rows.select("path").distinct().join(changes.filter("kind = 'module_removed'").select(F.col("target").alias("path")), "path", "left_anti")
    return reports.drift_cells(there, changes)


@query(f"SELECT path, kind, x, y FROM {CELLS_SQL}")
def rpt_drift_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(f"""SELECT concat('<svg xmlns="http://www.w3.org/2000/svg" width="1100" height="', max(y) + 64, '">', chr(10), string_agg(concat('<rect x="', x, '" y="', y, '" width="34" height="22" fill="', CASE kind WHEN 'module_modified' THEN '#ffb000' WHEN 'module_removed' THEN '#ff4040' ELSE '#101a33' END,
  '" stroke="#30d5ff"><title>', replace(path, '&', '&amp;'), '</title></rect>'), chr(10) ORDER BY y, x), chr(10), '</svg>') AS svg FROM {CELLS_SQL}""")
def rpt_drift_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.drift_svg(_cells(spark, sf_dir), {"module_modified": "#ffb000", "module_removed": "#ff4040"})


@query("""SELECT tree, CASE WHEN b + n + i = 0 THEN 'no drift (architecture unchanged)' ELSE concat(b + n + i, ' drift: ', b, ' breaking, ', n, ' notable, ', i, ' info') END AS line FROM (SELECT doc_id % 9 AS tree, count(*) FILTER (doc_id % 9 <> 4 AND doc_id % 11 = 0) AS b, count(*) FILTER (doc_id % 9 <> 4 AND doc_id % 13 = 0) AS n,
  count(*) FILTER (doc_id % 9 <> 4 AND doc_id % 17 = 0) AS i FROM documents GROUP BY 1)""")
def rpt_drift_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    of = lambda k: F.count_if((d % 9 != 4) & (d % k == 0))
    rows = table(spark, sf_dir, "documents").groupBy((d % 9).alias("tree")).agg(of(11).alias("b"), of(13).alias("n"), of(17).alias("i"))
    return rows.select("tree", reports.drift_line(F.col("b"), F.col("n"), F.col("i")).alias("line"))


EVENTS_SQL = """(SELECT event_id, ['node_start', 'node_done', 'node_error', 'finding', 'payment', 'swarm_start', 'swarm_done', 'note', 'other'][1 + event_id % 9] AS kind, concat('n', user_id) AS node, event_type, value FROM events)"""


@query(f"""SELECT event_id, CASE kind WHEN 'node_start' THEN concat('⟳ ', node, ' started') WHEN 'node_done' THEN concat('✓ ', node, ' done — ', event_id % 4, ' finding(s), 0 file(s), ', printf('%.2f', floor(value)), 's') WHEN 'node_error' THEN concat('✗ ', node, ' failed — ', event_type)
  WHEN 'finding' THEN concat('⚑ ? ', event_type, ' ', node) WHEN 'payment' THEN concat('💳 settled ', printf('%.6f', floor(value)), ' USDC → ', node) WHEN 'swarm_start' THEN '🕸️ swarm starting — nodes: a, b' WHEN 'swarm_done' THEN concat('✓ swarm complete — ', event_id % 4, ' finding(s) in ', printf('%.2f', floor(value)), 's')
  WHEN 'note' THEN event_type ELSE kind END AS line FROM {EVENTS_SQL}""")
def rpt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["node_start", "node_done", "node_error", "finding", "payment", "swarm_start", "swarm_done", "note", "other"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 9 + 1).cast("int"))
    n, whole = (F.col("event_id") % 4).cast("string"), F.floor("value").cast("string")
    node = F.concat(F.lit("n"), F.col("user_id").cast("string"))
    fields = {"findings": n, "duration": whole, "error": F.col("event_type"), "rule": F.col("event_type"), "where": node, "amount_usdc": whole, "payTo": node, "nodes": F.lit("a, b")}
    payload = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    payload = F.when(kind == "note", F.map_concat(payload, F.create_map(F.lit("msg"), F.col("event_type")))).otherwise(payload)
    return table(spark, sf_dir, "events").select("event_id", reports.event_line(kind, node, payload).alias("line"))


OPTIONS = [("view", 0, "seen"), ("view", 1, "looked at"), ("view", 2, "noticed"), ("error", 0, "sorry"), ("click", 0, "pressed"), ("click", 1, "touched")]


@query(f"""SELECT event_id, o.text AS reply FROM (SELECT event_id, event_type, ('0x' || left(sha256(lower(trim(concat(' E', user_id)))), 2))::INT AS b FROM events) e LEFT JOIN (SELECT intent, max(i) + 1 AS n FROM (VALUES {_literal(OPTIONS)}) AS v(intent, i, text) GROUP BY intent) s ON s.intent = event_type
  LEFT JOIN (VALUES {_literal(OPTIONS)}) AS o(intent, i, text) ON o.intent = event_type AND o.i = b % n""")
def voi_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's type stands for an intent, its user for what was said."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit(" E"), F.col("user_id").cast("string")).alias("said"))
    return reports.replies(rows, "event_type", "said", spark.createDataFrame(OPTIONS, "intent string, i int, text string")).select("event_id", "reply")


#: (ok, reason, chat, addressed, has_text, has_file, kind, error, throttled, operator)
UPDATES = [
    (False, "bot", "private", False, True, False, "help", None, False, False), (True, "dm", "private", False, False, True, "reject", "empty message", False, False), (True, "group", "group", False, True, False, "audit", None, False, False),
    (True, "group", "supergroup", True, True, False, "audit", None, True, True), (True, "group", "group", True, True, False, "reject", "not a command", False, False), (True, "dm", "private", False, True, False, "judge", None, False, False),
    (True, "dm", "private", False, True, False, "judge", None, False, True), (True, "dm", "private", False, True, False, "reject", "unknown command", False, False), (True, "dm", "private", False, True, False, "crawl", None, False, True), (True, "dm", "private", False, True, False, "lore", None, True, True),
]


@query(f"""SELECT doc_id, CASE WHEN NOT ok THEN 'denied' WHEN chat IN ('group', 'supergroup') AND NOT addressed THEN 'ignored' WHEN NOT has_text AND has_file THEN 'upload' WHEN kind IN {fixed.EXPENSIVE} AND throttled THEN 'ignored' WHEN kind = 'reject' AND error IN ('not a command', 'empty message') THEN 'social'
    WHEN kind = 'judge' AND NOT operator THEN 'denied' WHEN kind IN ('reject', 'start', 'help', 'spellbook', 'sigil', 'lore', 'judge') THEN 'replied' ELSE 'run' END AS action, CASE WHEN NOT ok THEN reason WHEN chat IN ('group', 'supergroup') AND NOT addressed THEN 'not addressed in group' WHEN NOT has_text AND has_file THEN 'document'
    WHEN kind IN {fixed.EXPENSIVE} AND throttled THEN concat('cooldown:', kind) WHEN kind = 'reject' AND error IN ('not a command', 'empty message') THEN error WHEN kind = 'judge' AND NOT operator THEN 'judge-operator-only' WHEN kind = 'reject' THEN concat('reject:', error) ELSE kind END AS detail
  FROM {_cases_sql(UPDATES, 'ok, reason, chat, addressed, has_text, has_file, kind, error, throttled, operator')}""")
def bot_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "ok boolean, reason string, chat string, addressed boolean, has_text boolean, has_file boolean, kind string, error string, throttled boolean, operator boolean"
    found = reports.dispatched(*[F.col(x.split()[0]) for x in names.split(", ")])
    return _cases(spark, sf_dir, UPDATES, names).select("doc_id", found["action"].alias("action"), found["detail"].alias("detail"))
