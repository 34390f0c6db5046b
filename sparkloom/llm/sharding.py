"""Shards by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws ``-ln(u) / weight``, where ``u`` is uniform and depends only on the
seed, the child's name and the key; the least draw wins. A child therefore wins in proportion to its
weight, and a change of its weight moves keys between it and its siblings only: a key that stays in
an unchanged subtree keeps its shard.

The weight of an inner node is the sum of the weights of its shards. The standard tree has two regions of two racks of two
shards; a few more shards are regions of their own. From ``BALANCED`` shards on, regions, racks and racks' shards are as
many as the cube root of their number, so a key draws about three times that often. A tree grows by a region of its own, so
one more shard takes keys only into itself. The tree is data: its arrays do not make the expression larger.

Defined results: a null key draws like the word ``null``; a null text has size 1 and checksum 0; equal keys always meet in
one shard; of equal draws the child that comes first wins; repeated rows get slots of their own; very long texts are only
measured; an empty table gives an empty table; columns beside the key and text are ignored, whatever their names. Slots run
from 0 without gaps in each shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import utf8_bytes

SEED = "tree-1"
#: Parts of a shard that are numbered apart. Each holds 1/4096 of a shard, however large the table.
SLOT_PARTS = 4096
#: Shards from which on a tree is balanced.
BALANCED = 17


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree, and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def standard_tree(shards: int) -> list[Leaf]:
    if shards >= BALANCED:
        wide = math.ceil(shards ** (1 / 3) - 1e-9)
        return [Leaf(f"r{i // wide**2}", f"k{i // wide % wide}", i) for i in range(shards)]
    leaves = [Leaf(f"r{i // 4}", f"k{i // 2 % 2}", i) for i in range(min(shards, 8))]
    while len(leaves) < shards:
        leaves = grown(leaves)
    return leaves


def grown(tree: list[Leaf]) -> list[Leaf]:
    """The tree with one more shard, a region of its own."""
    shard = max((x.shard for x in tree), default=-1) + 1
    return [*tree, Leaf(f"r{shard}x", "k0", shard)]


def draw(key: Column, name: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential draw of one child; 52 bits of an MD5 give the uniform number."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), name, F.lit("|"), F.coalesce(key.cast("string"), F.lit("null"))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 1.0) / float(2**52 + 1)) / weight


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _children(nodes: list[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")) for name, weight in nodes])


def shard_of(key: Column, tree: list[Leaf], seed: str = SEED) -> Column:
    """Shard of a key in a tree; only leaves of positive weight can be drawn."""
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard of positive weight")
    nodes: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in live:
        nodes.setdefault(f"/{leaf.region}", {}).setdefault(f"/{leaf.region}/{leaf.rack}", []).append(leaf)
    weight = lambda leaves: sum(x.weight for x in leaves)
    regions = _children([(name, sum(map(weight, racks.values()))) for name, racks in nodes.items()])
    racks = F.array(*[_children([(name, weight(leaves)) for name, leaves in inner.items()]) for inner in nodes.values()])
    shards = F.array(*[F.array(*[_children([(f"{name}/{x.shard}", x.weight) for x in leaves]) for name, leaves in inner.items()]) for inner in nodes.values()])
    ids = F.array(*[F.array(*[F.array(*[F.lit(x.shard) for x in leaves]) for leaves in inner.values()]) for inner in nodes.values()])

    def least(children: Column) -> Column:
        drawn = F.transform(children, lambda c: draw(key, c["name"], c["weight"], seed))
        return _let(drawn, lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)

    picked = _let(least(regions), lambda r: _let(least(F.get(racks, r)), lambda k: F.get(F.get(F.get(ids, r), k), least(F.get(F.get(shards, r), k)))))
    return picked.cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, seed: str = SEED, tree: list[Leaf] | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard), one row per input row, in a tree or the standard one.

    Slots are numbered in two steps: rows within small parts of each shard, and the parts' offsets by
    their counts, so no task ever orders a whole shard.
    """
    tree = tree or standard_tree(shards)
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")
    placed = df.select(
        k.alias(key),
        (utf8_bytes(t) + 1).alias("size"),
        F.crc32(F.coalesce(F.encode(t, "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(k, tree, seed).alias("shard"),
        shard_of(k, grown(tree), seed).alias("grown_shard"),
    )
    named = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("|"), F.col("text_crc32").cast("string"))
    placed = placed.withColumn("part", F.pmod(F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long"), F.lit(SLOT_PARTS)))
    counted = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(  # at most shards x SLOT_PARTS rows
        counted.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy(key, "text_crc32", "size"))
    return (
        placed.withColumn("row", within)
        .join(offsets, ["shard", "part"])
        .select(key, "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("row") - 1).alias("slot"), "grown_shard")
    )
