"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, files


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of its component, for each node that has a link to another node.

    Each step replaces links by links to the least neighbour; it groups and joins, and never holds a
    component in one task. Steps are cut in the checkpoint folder, in files for the number of links, which no step adds to.
    Null ends and loops are ignored.
    """
    n = links.count()
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(edges.filter(edges[2]).select("u", "v").distinct().coalesce(files(n)))
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.filter(F.col("u") != F.col("v")).distinct().coalesce(files(n)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen, n = now, now[0]
