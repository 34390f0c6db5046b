"""Graphs as two tables: (src, dst) links, which may repeat, and (key) nodes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import url


SHOWN_MEMBERS = 12


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, in_degree) with zeros, repeated links counted."""
    n = edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("in_degree"))
    return nodes.select("key").join(n, "key", "left").select("key", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def hubs(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` keys with most incoming links; ties by key."""
    return edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "key").limit(k)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no link leaves or enters."""
    used = edges.select(F.col("src").alias("key")).union(edges.select(F.col("dst").alias("key")))
    return nodes.select("key").join(used, "key", "left_anti")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes and links by kind, and in all (kind ``*``)."""
    both = nodes.select(F.lit("node").alias("what"), "kind").unionAll(edges.select(F.lit("edge").alias("what"), "kind"))
    return both.rollup("what", "kind").agg(F.count("*").alias("n")).filter("what is not null").select("what", F.coalesce("kind", F.lit("*")).alias("kind"), "n")


def _kept(df: DataFrame) -> DataFrame:
    """Rows held across a loop's turn, in the shared checkpoint folder that the session names.

    A folder of our own is set only on one machine; a cluster without a shared one is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-"))
    return df.checkpoint()


def walk(edges: DataFrame, seeds: DataFrame, depth: int = 2, allowed: DataFrame | None = None) -> DataFrame:
    """(key, depth): breadth-first from ``seeds`` (key), each key at its least depth; only ``allowed`` keys if given."""
    steps = edges.select("src", "dst").distinct()
    if allowed is not None:
        steps = steps.join(allowed.select(F.col("key").alias("dst")), "dst", "left_semi")
    seen = frontier = _kept(seeds.select("key").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        reached = steps.join(frontier, steps["src"] == frontier["key"]).select(F.col("dst").alias("key")).distinct()
        frontier = _kept(reached.join(seen, "key", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = _kept(seen.union(frontier))
    return seen


def _spread(start: DataFrame, links: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(key, mark): the greatest mark that reaches each key along links (src, dst); only to keys of its own (key, mark) if given."""
    marks = _kept(start)
    while True:
        sent = links.join(marks, links["src"] == marks["key"]).select(F.col("dst").alias("key"), "mark")
        if same is not None:
            sent = sent.join(same, ["key", "mark"], "left_semi")
        after = _kept(marks.union(sent).groupBy("key").agg(F.max("mark").alias("mark")))
        before = after.join(marks, ["key", "mark"], "left_anti")
        if before.isEmpty():
            return after
        marks = after


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, members): groups of keys that reach each other, and keys that link to themselves.

    Keys without a link in or out are trimmed. Each key then takes the greatest key that reaches it; a key that keeps its
    own is with all of that mark from which it can be reached. Those are a group, and are taken away until no link is left.
    Only keys with a mark are held, never the pairs that reach each other. ``members`` are the first ``SHOWN_MEMBERS``.
    """
    whole = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    loops = whole.filter("src = dst").select(F.col("src").alias("key"), F.col("src").alias("mark"))
    left, found = _kept(whole.filter("src <> dst")), _kept(loops)
    while not left.isEmpty():
        n = left.count()
        trimmed = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        trimmed = _kept(trimmed.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if trimmed.count() < n:
            left = trimmed
            continue
        keys = left.select(F.col("src").alias("key")).distinct()
        marks = _spread(keys.withColumn("mark", F.col("key")), left)
        back = left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        groups = _spread(marks.filter("key = mark"), back, marks)
        found = _kept(found.union(groups))
        gone = groups.select("key")
        left = left.join(gone.withColumnRenamed("key", "src"), "src", "left_anti").join(gone.withColumnRenamed("key", "dst"), "dst", "left_anti").select("src", "dst")
        left = _kept(left)
    # A key that links to itself may also be in a larger group, whose mark it then takes.
    named = found.join(found.groupBy("mark").count(), "mark").groupBy("key").agg(F.max_by("mark", "count").alias("mark"))
    sizes = named.groupBy("mark").agg(F.min("key").alias("component"), F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy("mark").orderBy("key"))
    shown = named.withColumn("place", place).filter(F.col("place") <= SHOWN_MEMBERS).groupBy("mark").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("members"))
    return sizes.join(shown, "mark").select("component", "size", "members")


def external_hosts(links: DataFrame, order: list[str], most: int = 40) -> DataFrame:
    """(host, n) of links (src, dst) to another origin: of the hosts that come first in ``order``, at most ``most``."""
    host = F.coalesce(F.nullif(url.host(F.col("dst")), F.lit("")), F.lit("?"))
    rows = links.filter(~url.same_origin(F.col("src"), F.col("dst"))).withColumn("host", host)
    first = rows.groupBy("host").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return first.orderBy("first").limit(most).select("host", "n")
