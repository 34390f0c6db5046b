"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (domain, language, source) has a token budget at its root. Each node's share of its parent's budget is
its weight among its siblings; a node that has too few tokens, all allowed epochs counted, leaves its shortage to its
siblings, in proportion to their weights, and only what the whole family lacks goes to the family's own siblings, the
ancestors' level. Both follow from one rule, applied from the root down: children take ``min(capacity, level * weight)``
of what their parent got, with the level that uses it up, and a parent never gets more than its children can take.

Each leaf then reads its rows in a seeded order, another one in each epoch, and takes the prefix of that many tokens;
the last row taken may be cut short (``take`` tokens of its ``tokens``).

Tokens are runs of characters between whitespace. The prefix sums are taken within small parts of a leaf's seeded order
and over the parts' totals, so a leaf that holds a third of all rows is spread over all tasks.

Defined results: null texts and texts without tokens are never taken; null level values are a node named ``-``; repeated
rows are rows of their own; ties in the seeded order go to the lesser id; a weight of 0 takes nothing; unnamed nodes weigh 1;
an empty table or budget takes nothing; very long texts are only counted, in linear time; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import broadcast_if_small, cut

SEED, EPOCHS, SHARE = "mix-1", 2, 0.6
LEVELS = ("domain", "lang", "source")
#: Parts of a leaf's seeded order that are summed apart: at least so many, and so many rows in one if a leaf has all.
PARTS, PART_ROWS = 1024, 500_000


def n_tokens(text: Column) -> Column:
    """Runs of characters other than whitespace. Splitting takes linear time."""
    solid = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(solid == "", 0).otherwise(F.length(solid) - F.length(F.replace(solid, F.lit(" "), F.lit(""))) + 1).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """A source's domain where the table names none: one of ``domains``, by the source's CRC-32."""
    return F.concat(F.lit("domain"), (F.crc32(F.encode(F.coalesce(source, F.lit("-")), "UTF-8")) % domains).cast("string"))


def _weight(levels: tuple[str, ...], depth: int, weights: dict[tuple[str, ...], float]) -> Column:
    """Weight of the node that the first ``depth`` level values name."""
    out = F.lit(1.0)
    for path, weight in weights.items():
        if len(path) == depth:
            out = F.when(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(levels, path, strict=False)]), float(weight)).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: tuple[str, ...], total: Column | float, weights: dict[tuple[str, ...], float] | None = None) -> DataFrame:
    """``leaves`` (the levels and ``capacity``) with ``budget``, a whole number of tokens."""
    weights = weights or {}
    nodes = [leaves]
    for depth in range(len(levels), 0, -1):
        level = nodes[0].withColumn("weight", _weight(levels, depth, weights)).withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0))
        nodes[0] = level
        nodes.insert(0, level.groupBy(*levels[: depth - 1]).agg(F.sum("capacity").alias("capacity")))
    got = nodes[0].select(F.least(F.col("capacity"), F.lit(total).cast("double")).alias("budget"))
    for depth in range(1, len(levels) + 1):
        parent = got.withColumnRenamed("budget", "family")
        shared = list(levels[: depth - 1])
        children = nodes[depth].join(parent, shared) if shared else nodes[depth].join(F.broadcast(parent))
        by = Window.partitionBy(*shared) if shared else Window.partitionBy(F.lit(0))
        order = by.orderBy(F.col("capacity") / F.col("weight"), *levels[:depth])
        live = children.filter("weight > 0")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        level = (F.col("family") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / (F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        filled = live.withColumn("level", level).withColumn("level", F.max("level").over(by))
        got = filled.select(*levels[:depth], F.greatest(F.lit(0.0), F.least("capacity", F.col("level") * F.col("weight"))).alias("budget"))
    return got.withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    levels: dict[str, Column] | None = None,
    weights: dict[tuple[str, ...], float] | None = None,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, the levels, tokens, epoch, start, take, budget), one row for each row taken in each epoch.

    ``share`` is the root's budget as a part of all tokens. ``start`` is where the row begins in its leaf's order.
    """
    levels = levels or {"domain": domain_of(F.col("source").cast("string")), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")}
    names = tuple(levels)
    t = F.col(f"`{text}`").cast("string")
    rows = df.select(F.col(f"`{doc_id}`").alias(doc_id), *[F.coalesce(c.cast("string"), F.lit("-")).alias(n) for n, c in levels.items()], n_tokens(t).alias("tokens"), F.crc32(F.encode(t, "UTF-8")).alias("mark"))
    rows = cut(rows.filter("tokens > 0"))
    total, count = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    parts = max(PARTS, -(-count // PART_ROWS))
    leaves = rows.groupBy(*names).agg((F.sum("tokens") * epochs).cast("double").alias("capacity"))
    plan = broadcast_if_small(cut(budgets(leaves, names, float(int(total * share)), weights)))

    key = F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("mark").cast("string"))
    drawn = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("draw", F.md5(key))
    drawn = drawn.withColumn("part", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / 2**32 * parts).cast("int"))
    sums = drawn.groupBy(*names, "epoch", "part").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy(*names).orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*names, "epoch", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    # Parts that begin beyond the leaf's budget hold no row that is taken.
    offsets = offsets.join(plan, list(names)).filter(F.col("offset") < F.col("budget"))
    within = Window.partitionBy(*names, "epoch", "part").orderBy("draw", doc_id).rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.join(offsets, [*names, "epoch", "part"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    taken = placed.filter(F.col("start") < F.col("budget"))
    return taken.select(doc_id, *names, "tokens", "epoch", "start", F.least("tokens", F.col("budget") - F.col("start")).alias("take"), "budget")
