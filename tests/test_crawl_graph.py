"""Crawls, site maps and cycles against plain statements."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import crawl, graph, scan
from sparkloom.plans.code import BAD, GOOD

SITE = "https://a.example/"


def plain_crawl(site, seed, barred, limits):
    """One queue, one page after the other."""
    queue, seen, pages, skipped, used = [(seed, 0)], {seed}, [], [], 0
    while queue and len(pages) < limits.pages and used < limits.total_bytes:
        url, depth = queue.pop(0)
        if url in barred:
            skipped.append((url, "robots-disallowed"))
            continue
        if url not in site:
            pages.append((url, depth, "fetch failed"))
            continue
        status, kind, size, links = site[url]
        error = f"HTTP {status}" if status != 200 else "page too large" if size > limits.page_bytes else "not html" if kind not in ("", "text/html") else ""
        pages.append((url, depth, error))
        if error:
            continue
        used += size
        for target in links:
            if target.startswith(SITE) and target not in seen and depth + 1 <= limits.depth:
                seen.add(target)
                queue.append((target, depth + 1))
    return pages, skipped


def test_crawl_equals_a_queue(spark):
    rng = random.Random(3)
    site = {}
    for i in range(40):
        links = [f"{SITE}{rng.randrange(50)}" for _ in range(rng.randrange(7))] + ["https://b.example/"] * rng.randrange(2)
        site[f"{SITE}{i}"] = (rng.choice([200, 200, 200, 404]), rng.choice(["", "text/html", "text/html", "image/png"]), rng.randrange(50, 400), links)
    df = spark.createDataFrame([(u, *v) for u, v in site.items()], "url string, status int, type string, bytes long, links array<string>")
    barred = [f"{SITE}{i}" for i in (7, 8, 9)]
    site[f"{SITE}1"] = df_row = (200, "", 60, [f"{SITE}{i}" for i in range(2, 30, 3)])
    df = df.filter(F.col("url") != f"{SITE}1").unionByName(spark.createDataFrame([(f"{SITE}1", *df_row)], df.schema))
    for limits in (crawl.Limits(), crawl.Limits(pages=5), crawl.Limits(pages=99, total_bytes=900), crawl.Limits(pages=99, depth=3, page_bytes=300)):
        pages, skipped = crawl.crawl(df, f"{SITE}1", ~F.col("url").isin(*barred), limits)
        want, lost = plain_crawl(site, f"{SITE}1", barred, limits)
        assert [(r["url"], r["depth"], r["error"]) for r in pages.orderBy("place").collect()] == want
        assert sorted((r["url"], r["reason"]) for r in skipped.collect()) == sorted(lost)


def test_cycles_equal_plain_reach(spark):
    rng = random.Random(8)
    for n, m in ((12, 14), (30, 45), (6, 20)):
        links = {(f"k{rng.randrange(n)}", f"k{rng.randrange(n)}") for _ in range(m)}
        reach = set(links)
        while True:
            more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
            if not more:
                break
            reach |= more
        want = {}
        for a, b in reach:
            if (b, a) in reach:
                want.setdefault(a, set()).add(b)
        want = {(min(v), len(v), ",".join(sorted(v)[:12])) for v in want.values()}
        got = graph.cycles(spark.createDataFrame([*links, (None, "x"), ("x", None)], "src string, dst string")).collect()
        assert {(r["component"], r["size"], r["members"]) for r in got} == want and len(got) == len(want)
    assert graph.cycles(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_contract_rules_fire_and_do_not(spark):
    lines = scan.code_lines(spark.createDataFrame([("src/Bad.sol", BAD), ("src/Good.sol", GOOD), ("tests/Bad.sol", BAD)], "path string, body string"), "path", "body")
    found = {(r["path"], r["rule"], r["line"], r["severity"]) for r in scan.contract_findings(lines).collect()}
    assert {f for f in found if f[0] == "src/Good.sol"} == set()
    for want in [("tx_origin_auth", 4, "critical"), ("unchecked_call", 5, "high"), ("reentrancy_state_after_call", 6, "critical"), ("weak_randomness", 12, "high"), ("weak_randomness", 17, "medium"), ("send_ignored", 19, "medium"), ("reentrancy_state_after_call", 20, "critical")]:
        assert ("src/Bad.sol", *want) in found, want
    assert ("src/Bad.sol", "weak_randomness", 14, "medium") not in found and ("tests/Bad.sol", "tx_origin_auth", 4, "high") in found
