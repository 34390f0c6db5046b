"""A bounded crawl of one site over a table of responses: first come, first fetched.

Responses are (url, status, type, bytes, links); links are absolute. Urls wait in the order they were first found. Before
each one the budgets are asked: pages fetched so far, and bytes of good pages. A failure is a page too and uses the page
budget, but not the byte budget. As the order goes level by level, a budget cuts a prefix, and every level needs one join.
What one level holds is bounded by the pages that are fetched and their links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import url as urls
from sparkloom.operators import graph, intake

PAGE = "url string, depth int, place long, status int, bytes long, error string, links array<string>"


@dataclass(frozen=True)
class Limits:
    pages: int = 12
    depth: int = 2
    page_bytes: int = 2_000_000
    total_bytes: int = 8_000_000
    url_length: int = 2048


def _error(limits: Limits) -> Column:
    bad = F.when(F.col("status").isNull(), "fetch failed").when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return bad.when(F.col("bytes") > limits.page_bytes, "page too large").when(~intake.is_page_type(F.col("type")), "not html").otherwise("")


def crawl(responses: DataFrame, seed: str, allowed: Column | None = None, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Pages (``PAGE``) in the order they were fetched, and (url, reason) of urls that were passed over.

    ``allowed`` is a condition on ``url``, as robots rules give; a url without a response is a failed page.
    """
    spark = responses.sparkSession
    along = Window.orderBy("at")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    frontier = spark.createDataFrame([(seed, 0)], "url string, at long")
    pages, skipped, seen, fetched, used = None, None, frontier.select("url"), 0, 0
    for depth in range(limits.depth + 1):
        met = frontier.join(responses.select("url", "status", "type", "bytes", "links"), "url", "left")
        reason = F.when(F.length("url") > limits.url_length, "url too long").when(~urls.same_origin(F.lit(seed), F.col("url")), "off-origin")
        reason = reason.when(~F.coalesce(F.lit(True) if allowed is None else allowed, F.lit(False)), "robots-disallowed").otherwise("")
        rows = met.withColumn("reason", reason).withColumn("error", F.when(F.col("reason") == "", _error(limits)))
        good = F.when(F.col("error") == "", F.col("bytes")).otherwise(0)
        rows = rows.withColumn("pages_before", F.coalesce(F.sum(F.when(F.col("reason") == "", 1).otherwise(0)).over(before), F.lit(0)) + fetched)
        rows = rows.withColumn("bytes_before", F.coalesce(F.sum(good).over(before), F.lit(0)) + used)
        rows = graph._kept(rows.filter((F.col("pages_before") < limits.pages) & (F.col("bytes_before") < limits.total_bytes)))
        own = rows.filter("reason = ''").select("url", F.lit(depth).alias("depth"), F.col("pages_before").cast("long").alias("place"), "status", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "error", F.when(F.col("error") == "", F.col("links")).alias("links"), "at")
        lost = rows.filter("reason <> ''").select("url", "reason")
        pages = own.drop("at") if pages is None else pages.unionByName(own.drop("at"))
        skipped = lost if skipped is None else skipped.unionByName(lost)
        total = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("error") == "", F.col("bytes"))), F.lit(0)).alias("b")).first()
        fetched, used = fetched + total["n"], used + total["b"]
        if depth == limits.depth or fetched >= limits.pages or used >= limits.total_bytes:
            break
        found = own.select("at", F.posexplode("links").alias("i", "url")).filter(urls.same_origin(F.lit(seed), F.col("url")) & (F.length("url") <= limits.url_length))
        first = found.groupBy("url").agg(F.min(F.struct("at", "i")).alias("from")).join(seen, "url", "left_anti")
        frontier = graph._kept(first.select("url", F.row_number().over(Window.orderBy("from")).cast("long").alias("at")))
        seen = graph._kept(seen.union(frontier.select("url")))
    return pages, skipped


def edges(pages: DataFrame, seed: str) -> DataFrame:
    """(src, dst) links of the pages inside the site, repeats and all."""
    return pages.select(F.col("url").alias("src"), F.explode("links").alias("dst")).filter(urls.same_origin(F.lit(seed), F.col("dst")))


def top_pages(pages: DataFrame, seed: str, k: int = 8) -> DataFrame:
    """The ``k`` pages with most links to them, then the shallowest, the shortest url, the first fetched."""
    degree = edges(pages, seed).groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("in_degree"))
    rows = pages.join(degree, "url", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)).cast("long"))
    return rows.orderBy(F.desc("in_degree"), "depth", F.length("url"), "place").limit(k).select("url", "depth", "in_degree")


def nested_locations(maps: DataFrame, roots: DataFrame, most_maps: int = 6, most_urls: int = 300) -> DataFrame:
    """(url) of the pages that site maps list: those of the roots, and of maps that they name, one level down.

    Maps are (url, is_index, locations); roots are (url, at) in the order they are read. At most ``most_maps`` maps are
    read, roots first, and the first ``most_urls`` pages kept; only pages of a map's own origin count.
    """
    top = roots.join(maps, "url").select(F.lit(0).alias("level"), "at", F.lit(0).alias("i"), "url", "is_index", "locations")
    named = top.filter("is_index").select(F.lit(1).alias("level"), "at", F.posexplode("locations").alias("i", "loc"), F.col("url").alias("from"))
    named = named.filter(urls.same_origin(F.col("from"), F.col("loc"))).join(maps.withColumnRenamed("url", "loc"), "loc").select("level", "at", "i", F.col("loc").alias("url"), "is_index", "locations")
    order = F.struct("level", "at", "i")
    read = top.unionByName(named).groupBy("url").agg(F.min(order).alias("o"), F.first("is_index").alias("is_index"), F.first("locations").alias("locations")).orderBy("o").limit(most_maps)
    pages = read.filter(~F.col("is_index")).select("o", F.col("url").alias("from"), F.posexplode("locations").alias("i", "loc")).filter(urls.same_origin(F.col("from"), F.col("loc")))
    return pages.groupBy(F.col("loc").alias("url")).agg(F.min(F.struct("o", "i")).alias("o")).orderBy("o").limit(most_urls).select("url")
