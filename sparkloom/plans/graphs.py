"""Queries on graphs: parts and suppliers by their lines, nations by their regions, and small literal graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import crawl, graph
from sparkloom.plans.documents import _literal
from sparkloom.plans.registry import query
from sparkloom.session import table


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lower("l_returnflag").alias("kind"))


EDGES_SQL = "(SELECT concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst, lower(l_returnflag) AS kind FROM lineitem)"


@query(f"SELECT dst AS key, count(*)::BIGINT AS degree FROM {EDGES_SQL} GROUP BY dst ORDER BY degree DESC, key LIMIT 10")
def g_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(_supply(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.lit("part").alias("kind"))
    return parts.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.lit("nation").alias("kind")))


NODES_SQL = "(SELECT concat('p', p_partkey) AS key, 'part' AS kind FROM part UNION ALL SELECT n_name, 'nation' FROM nation)"


@query(f"SELECT key FROM {NODES_SQL} n WHERE NOT EXISTS (SELECT 1 FROM {EDGES_SQL} e WHERE e.src = n.key OR e.dst = n.key)")
def g_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(_parts(spark, sf_dir), _supply(spark, sf_dir))


@query(f"""SELECT 'node' AS what, kind, count(*)::BIGINT AS n FROM {NODES_SQL} GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM {EDGES_SQL} GROUP BY kind
  UNION ALL SELECT 'node', '*', count(*) FROM {NODES_SQL} UNION ALL SELECT 'edge', '*', count(*) FROM {EDGES_SQL}""")
def g_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(_parts(spark, sf_dir), _supply(spark, sf_dir))


@query(f"SELECT n.key, count(e.dst)::BIGINT AS in_degree FROM {NODES_SQL} n LEFT JOIN {EDGES_SQL} e ON e.dst = n.key GROUP BY n.key")
def g_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_parts(spark, sf_dir), _supply(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM nation UNION SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM supplier),
  w AS (SELECT 'r1' AS key, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.key WHERE w.depth < 3) SELECT key, min(depth)::INT AS depth FROM w GROUP BY key""")
def g_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"))
    more = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"))
    return graph.walk(down.union(more), spark.createDataFrame([("r1",)], "key string"), 3)


LINKS = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("c", "d"), ("f", "f"), ("g", "h"), ("h", "i"), ("e", "x"), ("x", "y")]


@query(f"""WITH RECURSIVE e AS (SELECT * FROM (VALUES {_literal(LINKS)}) AS l(src, dst)), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
  m AS (SELECT a.src, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT component, count(*)::BIGINT AS size, string_agg(src, ',' ORDER BY src) AS members FROM m GROUP BY component""")
def g_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(spark.createDataFrame(LINKS, "src string, dst string"))


#: A link from each page to one of 97 hosts, and from every third page to its own origin.
@query("""WITH l AS (SELECT page_id, concat('h', (page_id * 7919) % 97, '.example') AS host FROM pages WHERE page_id % 3 <> 0),
  h AS (SELECT host, count(*)::BIGINT AS n, min(page_id) AS first FROM l GROUP BY host), k AS (SELECT host, n, row_number() OVER (ORDER BY first) AS place FROM h) SELECT host, n FROM k WHERE place <= 40""")
def page_external_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    out = F.concat(F.lit("https://h"), ((page * 7919) % 97).cast("string"), F.lit(".example/"))
    links = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("src"), F.when(page % 3 == 0, F.concat("url", F.lit("?own"))).otherwise(out).alias("dst"))
    return graph.external_hosts(links, ["page_id"])


#: A site: regions link to nations, nations to suppliers, suppliers back to regions and elsewhere; some answers are bad.
SITE = "https://site.example/"
SITE_SQL = f"""(SELECT concat('{SITE}r', r_regionkey) AS url, 200 AS status, 'text/html' AS type, 1000 AS bytes, (SELECT list(concat('{SITE}n', n_nationkey) ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS links FROM region
  UNION ALL SELECT concat('{SITE}n', n_nationkey), CASE WHEN n_nationkey % 5 = 3 THEN 404 ELSE 200 END, 'text/html', 500 + n_nationkey, (SELECT list(concat('{SITE}s', s_suppkey) ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation
  UNION ALL SELECT concat('{SITE}s', s_suppkey), 200, CASE WHEN s_suppkey % 4 = 0 THEN 'image/png' ELSE '' END, 100 + s_suppkey, [concat('{SITE}r', s_nationkey % 5), 'https://other.example/', concat('{SITE}s', s_suppkey)] FROM supplier WHERE s_suppkey % 9 <> 2)"""


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda kind, key: F.concat(F.lit(SITE + kind), key.cast("string"))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    listed = lambda kind, key: F.transform(F.array_sort(F.collect_list(key)), lambda k: at(kind, k)).alias("links")
    regions = table(spark, sf_dir, "region").join(nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(listed("n", F.col("n_nationkey"))), "r_regionkey", "left")
    nations = nation.join(supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(listed("s", F.col("s_suppkey"))), "n_nationkey", "left")
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    one = regions.select(at("r", F.col("r_regionkey")).alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("type"), F.lit(1000).cast("long").alias("bytes"), "links")
    two = nations.select(at("n", k).alias("url"), F.when(k % 5 == 3, 404).otherwise(200).alias("status"), F.lit("text/html").alias("type"), (500 + k).cast("long").alias("bytes"), "links")
    links = F.array(at("r", F.col("s_nationkey") % 5), F.lit("https://other.example/"), at("s", s))
    three = supplier.filter(s % 9 != 2).select(at("s", s).alias("url"), F.lit(200).alias("status"), F.when(s % 4 == 0, "image/png").otherwise("").alias("type"), (100 + s).alias("bytes"), links.alias("links"))
    return one.unionByName(two).unionByName(three)


BARRED = "starts_with(url, 'https://site.example/s1')"
CRAWL_SQL = f"""site AS {SITE_SQL}, l0 AS (SELECT '{SITE}r1' AS url, 0 AS depth, 1 AS pos),
  f1 AS (SELECT u AS url, min((pos, i)) AS o FROM (SELECT pos, unnest(links) AS u, unnest(range(len(links))) AS i FROM l0 JOIN site USING (url)) WHERE starts_with(u, '{SITE}') GROUP BY u),
  l1 AS (SELECT url, 1 AS depth, row_number() OVER (ORDER BY o) AS pos FROM f1 WHERE url NOT IN (SELECT url FROM l0)),
  f2 AS (SELECT u AS url, min((pos, i)) AS o FROM (SELECT pos, unnest(links) AS u, unnest(range(len(links))) AS i FROM l1 JOIN site USING (url) WHERE status = 200) WHERE starts_with(u, '{SITE}') GROUP BY u),
  l2 AS (SELECT url, 2 AS depth, row_number() OVER (ORDER BY o) AS pos FROM f2 WHERE url NOT IN (SELECT url FROM l0) AND url NOT IN (SELECT url FROM l1)),
  q AS (SELECT a.url, depth, pos, status, coalesce(bytes, 0) AS bytes, links, CASE WHEN {BARRED.replace('url', 'a.url')} THEN 'robots-disallowed' ELSE '' END AS reason, CASE WHEN status IS NULL THEN 'fetch failed' WHEN status <> 200 THEN concat('HTTP ', status) WHEN type = 'image/png' THEN 'not html' ELSE '' END AS error
    FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) a LEFT JOIN site s ON s.url = a.url),
  b AS (SELECT *, coalesce(sum((reason = '')::INT) OVER w, 0) AS pages_before, coalesce(sum(CASE WHEN reason = '' AND error = '' THEN bytes ELSE 0 END) OVER w, 0) AS bytes_before FROM q WINDOW w AS (ORDER BY depth, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  p AS (SELECT * FROM b WHERE pages_before < 25 AND bytes_before < 4500)"""
CRAWL_LIMITS = crawl.Limits(pages=25, total_bytes=4500)


@query(f"WITH {CRAWL_SQL} SELECT url, depth, CASE WHEN reason = '' THEN pages_before END::BIGINT AS place, CASE WHEN reason = '' THEN error ELSE reason END AS outcome FROM p")
def crawl_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and passed-over urls of a crawl with budgets, rules and failures."""
    pages, skipped = crawl.crawl(_site(spark, sf_dir), f"{SITE}r1", ~F.startswith("url", F.lit(f"{SITE}s1")), CRAWL_LIMITS)
    lost = skipped.select("url", F.lit(2).alias("depth"), F.lit(None).cast("long").alias("place"), F.col("reason").alias("outcome"))
    return pages.select("url", "depth", "place", F.col("error").alias("outcome")).unionByName(lost)


@query(f"""WITH {CRAWL_SQL}, e AS (SELECT unnest(links) AS dst FROM p WHERE reason = '' AND error = ''), d AS (SELECT dst AS url, count(*) AS n FROM e GROUP BY dst)
  SELECT url, depth, coalesce(n, 0)::BIGINT AS in_degree FROM p LEFT JOIN d USING (url) WHERE reason = '' QUALIFY row_number() OVER (ORDER BY coalesce(n, 0) DESC, depth, length(url), pages_before) <= 8""")
def crawl_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = f"{SITE}r1"
    pages, _ = crawl.crawl(_site(spark, sf_dir), seed, ~F.startswith("url", F.lit(f"{SITE}s1")), CRAWL_LIMITS)
    return crawl.top_pages(pages, seed)


@query(f"WITH {CRAWL_SQL} SELECT depth, count(*)::BIGINT AS pages, count(*) FILTER (error <> '')::BIGINT AS failed, sum(bytes)::BIGINT AS bytes FROM p WHERE reason = '' GROUP BY depth")
def crawl_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _ = crawl.crawl(_site(spark, sf_dir), f"{SITE}r1", ~F.startswith("url", F.lit(f"{SITE}s1")), CRAWL_LIMITS)
    return pages.groupBy("depth").agg(F.count("*").alias("pages"), F.count_if(F.col("error") != "").alias("failed"), F.sum("bytes").alias("bytes"))


#: Nations are site maps, every fourth an index of others; the first regions' maps are roots.
MAPS_SQL = f"(SELECT concat('{SITE}m', n_nationkey) AS url, n_nationkey % 4 = 0 AS is_index, CASE WHEN n_nationkey % 4 = 0 THEN [concat('{SITE}m', (n_nationkey + 1) % 25), concat('{SITE}m', (n_nationkey + 2) % 25), 'https://other.example/m'] ELSE [concat('{SITE}p', n_nationkey), concat('{SITE}p', n_nationkey % 3), 'https://other.example/p'] END AS locations FROM nation)"


@query(f"""WITH m AS {MAPS_SQL}, top AS (SELECT 0 AS level, pos, 0 AS i, m.* FROM m JOIN (SELECT concat('{SITE}m', unnest([4, 2, 8])) AS url, unnest([0, 1, 2]) AS pos) r USING (url)),
  low AS (SELECT 1 AS level, pos, i, m.* FROM (SELECT pos, unnest(locations) AS loc, unnest(range(len(locations))) AS i FROM top WHERE is_index) JOIN m ON m.url = loc WHERE starts_with(loc, '{SITE}')),
  r AS (SELECT url, min((level, pos, i)) AS o, any_value(is_index) AS is_index, any_value(locations) AS locations FROM (SELECT * FROM top UNION ALL SELECT * FROM low) GROUP BY url QUALIFY row_number() OVER (ORDER BY o) <= 6),
  l AS (SELECT loc AS url, min((o, i)) AS o FROM (SELECT o, unnest(locations) AS loc, unnest(range(len(locations))) AS i FROM r WHERE NOT is_index) WHERE starts_with(loc, '{SITE}') GROUP BY loc) SELECT url FROM l QUALIFY row_number() OVER (ORDER BY o) <= 5""")
def crawl_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    at = lambda kind, key: F.concat(F.lit(SITE + kind), key.cast("string"))
    inner = F.array(at("m", (n + 1) % 25), at("m", (n + 2) % 25), F.lit("https://other.example/m"))
    maps = table(spark, sf_dir, "nation").select(at("m", n).alias("url"), (n % 4 == 0).alias("is_index"), F.when(n % 4 == 0, inner).otherwise(F.array(at("p", n), at("p", n % 3), F.lit("https://other.example/p"))).alias("locations"))
    roots = spark.createDataFrame([(f"{SITE}m{k}", i) for i, k in enumerate((4, 2, 8))], "url string, at int")
    return crawl.nested_locations(maps, roots, most_urls=5)
