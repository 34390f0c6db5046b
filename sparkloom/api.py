"""The entry points of the library by name: tables in, tables out.

``files`` are (path, body); ``pages`` have url and html; ``responses`` are (url, status, type, bytes, html); rule files are
(origin, body). Nothing here fetches, renders, signs or pays: those are sources and sinks of the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import fixed, text
from sparkloom.functions import url as urls
from sparkloom.operators import crawl as crawling
from sparkloom.operators import drift, gates, html, imports, manifests, policy, reports, scan, tree, trust, typed


def check_access(robots: DataFrame, llms: DataFrame) -> DataFrame:
    """What each origin publishes: rules, site maps, sections."""
    return gates.published(robots, llms)


def scrape(pages: DataFrame) -> DataFrame:
    """Title, language, words, headings, links and Markdown of each page."""
    page = html.pages(pages, visible=True, fields=("title", "lang", "word_count", "links", "headings", "description", "text"))
    md = html.markdown(F.col("page"))
    shown = [F.slice("page.headings", 1, 20).alias("headings"), F.size("page.links").alias("link_count"), F.left(md, F.lit(20_000)).alias("markdown"), (F.length(md) > 20_000).alias("truncated")]
    return page.select("url", "page.title", "page.lang", "page.word_count", *shown)


def trusted(pages: DataFrame) -> DataFrame:
    """(url, words, flags, score, verdict) of each page."""
    page = html.pages(pages, fields=("word_count", "json_ld", "hidden", "text")).withColumn("seen", F.col("page.text"))
    page = page.withColumn("hits", trust.hits(F.col("seen")))
    score = trust.trust_score(F.col("seen"), F.size("page.hidden"), urls.scheme(F.col("url")) == "https", structured=F.size("page.json_ld") > 0, flags=F.col("hits"))
    kinds = F.array(*[F.lit(k) for _, k in fixed.INJECTIONS])
    flags = F.array_distinct(F.transform(F.filter(F.arrays_zip("hits", kinds.alias("kind")), lambda x: x["hits"] == 1), lambda x: x["kind"]))
    rows = page.select("url", F.col("page.word_count").alias("words"), flags.alias("flags"), score.alias("score"))
    return rows.withColumn("verdict", trust.verdict(F.col("score")))


def extract_typed(pages: DataFrame, schema: str) -> DataFrame:
    """Outcome, fields, missing and invalid ones of each page for one schema."""
    return typed.extracted(pages, schema)


def _linked(responses: DataFrame) -> DataFrame:
    """Responses with the links of good pages, resolved against the page."""
    page = html.pages(responses.withColumn("good", F.when(F.col("status") == 200, F.col("html"))), "good", fields=("links",))
    links = F.transform(F.filter("page.links", lambda x: x["href"] != ""), lambda x: urls.join(F.col("url"), x["href"]))
    return page.withColumn("links", F.transform(F.array_compact(links), lambda x: F.when(urls.scheme(x).isin("http", "https"), urls.normal(x)).otherwise(x)))


def crawl(responses: DataFrame, seed: str, rules: DataFrame | None = None, limits: crawling.Limits = crawling.Limits()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(pages, passed over) of a bounded crawl of one site; ``rules`` are (origin, body) of robots files."""
    known = _linked(responses)
    if rules is None:
        return crawling.crawl(known, seed, None, limits)
    own = policy.robots_rules(rules).select(F.lit("site").alias("origin"), "kind", "value")
    barred = [r["value"] for r in own.filter("kind = 'disallow'").select("value").distinct().collect()]  # the rules of one site
    let = [r["value"] for r in own.filter("kind = 'allow'").select("value").distinct().collect()]
    path = urls.part(F.col("url"), 3)
    of = lambda values: F.greatest(F.lit(-1), F.lit(-1), *[F.when(F.startswith(F.when(path == "", "/").otherwise(path), F.lit(v)), F.lit(len(v))).otherwise(-1) for v in values])
    allowed = (of(barred) < 0) | (of(let) > of(barred))
    return crawling.crawl(known, seed, allowed, limits)


def map_site(responses: DataFrame, seed: str, most: int = 50) -> DataFrame:
    """(url) of a page's links inside its site, the first ``most``."""
    rows = _linked(responses).filter(F.col("url") == seed).select(F.posexplode("links").alias("i", "to")).filter(urls.same_origin(F.lit(seed), F.col("to")))
    return rows.groupBy(F.col("to").alias("url")).agg(F.min("i").alias("i")).orderBy("i").limit(most).select("url")


def audit(files: DataFrame, tree_name: str = "tree") -> dict[str, DataFrame]:
    """Findings, inventory, hot spots, languages, dependencies, imports and report of trees of files (tree, path, body)."""
    found = tree.findings(files, keep=[tree_name])
    languages = files.select(tree_name, tree.language(F.col("path")).alias("language")).filter("language is not null").groupBy(tree_name, "language").agg(F.count("*").alias("files"))
    listed = files.select("path", tree.ecosystem(F.col("path")).alias("eco"), "body").filter("eco is not null")
    return {
        "findings": tree.ordered(found, tree_name), "inventory": tree.inventory(files, tree_name), "hotspots": tree.hotspots(files, tree_name), "languages": languages, "dependencies": manifests.dependencies(listed),
        "imports": imports.file_edges(files, tree=tree_name), "report": reports.audit_markdown(found, languages, tree_name),
    }


def place(files: DataFrame) -> DataFrame:
    """Findings of the nodes of an audit: core secrets, contract rules and unpinned dependencies, each once."""
    known = files.filter(tree.is_node_file(F.col("path")))
    secrets = scan.findings(known, "path", "body", fixed.SECRETS).select("path", "line", "rule", "severity").dropDuplicates(["path", "line", "rule"])
    contracts = scan.contract_file_findings(files.filter(tree.is_contract(F.col("path"))), "path", "body").select("path", "line", "rule", "severity")
    loose = manifests.unpinned(scan.code_lines(known, "path", "body")).select("path", "line", F.lit("unpinned_dependency").alias("rule"), F.lit("low").alias("severity"))
    return secrets.unionByName(contracts).unionByName(loose)


def verify_report(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``findings`` with ``status`` against the files as they are now."""
    lines = scan.code_lines(files, "path", "body").select("path", "line", F.sha2(F.left(F.trim("text"), F.lit(200)), 256).alias("sha256"))
    return drift.verify(findings, lines)


def sentinel_capture(files: DataFrame) -> DataFrame:
    return imports.capture(files)


def sentinel_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, target, severity) between two captures."""
    named = lambda df: df.select(F.col("kind").alias("fact"), F.col("key").alias("target"), "hash")
    return drift.diff(named(before), named(after))


def watch(before: DataFrame, after: DataFrame) -> DataFrame:
    """(clean, breaking, exit_code, line) of one pass over two captures."""
    changes = sentinel_diff(before, after)
    of = lambda s: F.count_if(F.col("severity") == s)
    counts = changes.agg(of("breaking").alias("breaking"), of("notable").alias("notable"), of("info").alias("info"))
    total = F.col("breaking") + F.col("notable") + F.col("info")
    code = F.when(total == 0, 0).when(F.col("breaking") > 0, 1).otherwise(3)
    return counts.select((total == 0).alias("clean"), "breaking", code.alias("exit_code"), reports.drift_line(F.col("breaking"), F.col("notable"), F.col("info")).alias("line"))


def judge_page(pages: DataFrame, objective: str) -> DataFrame:
    """Evidence spans of each page for an objective, which must not be private; the decision itself is the caller's."""
    if not objective.strip() or len(objective.encode()) > 1024:
        raise ValueError("an objective has 1 to 1024 bytes")
    if pages.sparkSession.range(1).select(text.is_private(F.lit(objective))).first()[0]:
        raise ValueError("an objective must be public")
    return gates.evidence_spans(pages, "url", objective)
