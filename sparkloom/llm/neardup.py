"""Near copies by Order MinHash, verified by banded alignment.

A text's shingles are its runs of five words, in lower case; a text of fewer words is one shingle. Shingles that
occur again are told apart by their occurrence's number. For each of ``SKETCHES`` hash functions the ``PICKED`` least
labelled shingles are taken and put back in text order; the hash of that sequence is one component of the sketch.
Texts that share a component are candidates: of two texts whose similarity is 0.8, all but about 1 in 100,000 pairs
share one. Few shingles share fewer sequences than many, so texts of fewer than ``MANY`` take ``MORE`` hash functions.
Similar texts differ in at most a ninth of their shingles: a text of up to ``SHORT`` also has the hash of all its
labelled shingles and of all but each one as components, which miss no pair that differs in one shingle, or in one on each
side. Texts of fewer than ``EXACT`` shingles can differ in no other way and need no sketch.

Similarity is that of an alignment: the longest sequence of labelled shingles that both texts have in the same order,
divided by the shingles of both together. At the least similarity that counts, an alignment strays at most
``(n + m) / 9`` places from the diagonal, so only shingles within that band can be aligned.

Equal texts are one node. Candidates of a bucket are compared in three passes, after each of which linked texts share a
class, and pairs within a class are compared no more:

1. all texts of a bucket with its hub, the text that shares most buckets with others;
2. in a bucket of up to ``CELL`` texts, all that are still in different classes with each other. In a larger one texts that
   have the next component in common too form a finer group: they are compared with a hub drawn for that group, and,
   in random cells of about ``CELL`` texts, with each other;
3. all texts of a larger bucket that are still in different classes with each other.

Only pairs that can be similar are compared. Similar texts differ in at most ``(n + m) / 9`` shingles, and two texts differ
in no fewer shingles than in bits of their parities: bit i tells whether an odd number of labelled shingles has the hash i.
So of pairs that share a bucket no link is lost, whatever the bucket's size. The first two passes cost comparisons in
proportion to the texts of a bucket. The third costs as many bit counts as pairs remain: the texts beside a bucket's largest
class times all texts. It deals a bucket to tasks by pairs of blocks of about ``BLOCK`` texts; two blocks of the largest class, or of
lengths that cannot be similar, never meet.

Defined results: a null text is a class of its own; texts without words, such as empty ones, are in a class only with
their equals; a class is named by its least doc_id; rows with null ids take part and are named by their class; repeated
rows each get a row; ties between hubs go to the greater key; very long texts are hashed in pieces and take memory in
proportion to their words; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import broadcast_if_small, cut, files, small_batches
from sparkloom.llm.components import components

WORDS, SIMILARITY = 5, 0.8
SKETCHES, PICKED = 16, 3
#: Numbers of shingles, see above: below ``MANY`` there are ``MORE`` sketches, up to ``SHORT`` deletions, below ``EXACT`` these only.
MANY, MORE, SHORT, EXACT = 32, 20, 13, 8
#: Texts of a bucket, or of a random part of a larger group, that are compared with each other.
CELL = 256
#: Texts of a block of a larger bucket, of which two at a time are compared in full.
BLOCK = 1024
#: Parities of a text, in numbers of 64 bits.
PARITIES = 8
#: Bytes of text that are hashed at once, and hash draws held at once.
PIECE, DRAWS = 1 << 16, 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
S29, S32 = np.uint64(29), np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S29)) * TWO
    return (x ^ (x >> S32)) * ONE


#: Which bytes of UTF-8 are parts of words, as in ``WORD``, and a random number for each byte.
INSIDE = np.array([x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A for x in range(256)])
DRAWN = _mix(np.arange(1, 257, dtype=np.uint64) * TWO)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of ``ONE`` and of its inverse, modulo 2 to the 64."""
    back = np.uint64(pow(int(ONE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)])) for x in (ONE, back))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: its bytes' numbers as the digits of a polynomial, from sums over the whole text."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    edges = np.flatnonzero(np.diff(INSIDE[data].view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        low, high = starts[i], ends[j - 1]
        power, back = _powers(PIECE if high - low <= PIECE else int(high - low))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(DRAWN[data[low:high]] * power[: high - low])])
        out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * back[starts[i:j] - low]
        i = j
    return (_mix(out + (ends - starts).astype(np.uint64)) >> S32).astype(np.uint32)


def labelled(words: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles, and the same with the occurrence's number mixed in."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    w = words.astype(np.uint64)
    k = np.full(max(1, n - width + 1), np.uint64(min(n, width)))
    for i in range(min(n, width)):
        k = _mix(k * ONE + w[i : i + len(k)])
    order = np.argsort(k, kind="stable")
    ranked = k[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(k))
    nth = np.empty(len(k), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return k, np.where(nth > 0, _mix(k + nth * TWO), k)


def _deletions(labels: np.ndarray) -> list[int]:
    """Hash of all labels in order, and of all but each one where a text with one shingle less can be similar."""
    n = len(labels)
    rows = [labels[None, :]]
    if n + n - 1 >= 9:
        rows.append(np.broadcast_to(labels, (n, n))[~np.eye(n, dtype=bool)].reshape(n, n - 1))
    out: list[int] = []
    for same in rows:
        value = np.full(len(same), np.uint64(same.shape[1])) * TWO
        for x in same.T:
            value = _mix(value * ONE + x)
        out += value.view(np.int64).tolist()
    return out


def sketch(text: str | None, sketches: int | None = None, picked: int = PICKED) -> list[int]:
    """Components: Order MinHash, and deletions for short texts; none for a text without words."""
    return _components(*labelled(word_hashes(text or "")), sketches, picked)


def _described(text: str | None) -> tuple[list[int] | None, int, list[int] | None]:
    """Components, number of shingles, and parities."""
    if text is None:
        return None, 0, None
    k, labels = labelled(word_hashes(text))
    odd = np.bincount((labels & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return _components(k, labels), len(k), np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _components(k: np.ndarray, labels: np.ndarray, sketches: int | None = None, picked: int = PICKED) -> list[int]:
    if not len(k):
        return []
    exact = _deletions(labels) if len(k) <= SHORT else []
    if len(k) < EXACT:
        return exact
    sketches = sketches or (MORE if len(k) < MANY else SKETCHES)
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * TWO)
    least = np.empty((sketches, min(picked, len(k))), np.int64)
    step = max(1, DRAWS // len(k))  # long texts take a few hash functions at a time
    for i in range(0, sketches, step):
        draws = _mix(labels[None, :] ^ seeds[i : i + step, None])
        least[i : i + step] = np.argpartition(draws, picked - 1, axis=1)[:, :picked] if len(k) > picked else np.arange(len(k))
    least.sort(axis=1)
    value = np.arange(sketches, dtype=np.uint64)
    for x in k[least].T:
        value = _mix(value * ONE + x)
    return value.view(np.int64).tolist() + exact


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two texts' word hashes, or 0 if it is below ``least``."""
    p, q = max(1, len(a) - WORDS + 1) if len(a) else 0, max(1, len(b) - WORDS + 1) if len(b) else 0
    if not p or not q or min(p, q) < least * max(p, q) - 1e-9:
        return 0.0
    x, y = labelled(a)[1], labelled(b)[1]
    n, m = len(x), len(y)
    need = least * (n + m) / (1 + least)
    _, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(at_x - at_y) <= n + m - 2 * need + 1e-9
    if near.sum() < need - 1e-9:
        return 0.0
    places = at_y[near][np.argsort(at_x[near])]
    if (np.diff(places) > 0).all():
        length = len(places)
    else:
        tails: list[int] = []
        for p in places.tolist():
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
        length = len(tails)
    found = length / (n + m - length)
    return found if found >= least - 1e-9 else 0.0


def text_key(text: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a text; null for null."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _links(pairs: DataFrame, words: DataFrame, least: float, n: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar, in files for ``n`` rows; a hub is ``b``, whose many rows are narrow when they are dealt by it."""

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            similar = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) > 0 for x, y in zip(frame["wa"], frame["wb"], strict=True)]
            yield frame.loc[similar, ["a", "b"]]

    one = words.select(F.col("tid").alias("a"), F.col("words").alias("wa"))
    two = words.select(F.col("tid").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "wa", "wb")
    return cut(both.mapInPandas(verify, "a binary, b binary").repartition(files(n)))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))


def _linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots when further links are added."""
    return roots if links.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _pairs(grouped: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) to compare among rows (key, tid, root, n, p): with each group's hub, and in cells; never of one root."""
    sizes = grouped.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("x"), F.max("root").alias("y"), F.max(F.struct(F.xxhash64("tid", "key"), "tid", "root", "n", "p")).alias("h"))
    mixed = cut(grouped.join(sizes.filter("x <> y").select("key", "size", "h"), "key"))

    def alike(n: Column, m: Column, p: Column, q: Column) -> Column:
        odd = [F.bit_count(p[i].bitwiseXOR(q[i])) for i in range(PARITIES)]
        return (F.least(n, m) >= F.greatest(n, m) * least - 1e-9) & (functools.reduce(Column.__add__, odd) <= (n + m) * ((1 - least) / (1 + least)) + 1e-9)

    h = F.col("h")
    stars = mixed.filter((F.col("size") > CELL) & (F.col("root") != h["root"]) & alike(F.col("n"), h["n"], F.col("p"), h["p"])).select(F.col("tid").alias("a"), h["tid"].alias("b"))
    cell = F.pmod(F.xxhash64("key", "tid"), F.ceil(F.col("size") / CELL))
    one = mixed.select("key", cell.alias("cell"), F.col("tid").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("p").alias("pa"))
    two = one.select("key", "cell", F.col("a").alias("b"), F.col("ra").alias("rb"), F.col("na").alias("nb"), F.col("pa").alias("pb"))
    met = one.join(two, ["key", "cell"]).filter((F.col("ra") < F.col("rb")) & alike(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb")))
    both = stars.union(met.select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) to compare among rows (bucket, tid, root, n, p): all of a bucket and of different roots that can be similar."""
    roots = members.groupBy("bucket", "root").count()
    top = roots.groupBy("bucket").agg(F.count("*").alias("roots"), F.max(F.struct("count", "root")).alias("top")).filter("roots > 1")
    # Lengths of similar texts are of the same step or of two that follow each other.
    step = F.floor(F.log("n") / (0.01 - math.log(least)))
    rows = members.join(top, "bucket").withColumn("step", step).withColumn("main", F.col("root") == F.col("top")["root"])
    sizes = rows.groupBy("bucket", "step", "main").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))

    def name(cell: Column) -> Column:
        return F.concat_ws(":", "bucket", "step", "main", cell)

    blocks = sizes.select("bucket", "step", "main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cell"))
    blocks = cut(blocks.select("bucket", "step", "main", "cell", name(F.col("cell")).alias("block")))
    one = blocks.select("bucket", F.col("step").alias("s"), F.col("main").alias("m"), F.col("cell").alias("c"), F.col("block").alias("first"))
    two = blocks.withColumnRenamed("block", "second")
    ordered = (F.col("step") == F.col("s") + 1) | (F.col("step") == F.col("s")) & (F.struct("m", "c") <= F.struct("main", "cell"))
    meet = one.join(two, "bucket").filter(ordered & ~(F.col("m") & F.col("main"))).select("first", "second")
    sides = meet.select(F.col("first").alias("block"), "*").union(meet.filter("first <> second").select(F.col("second").alias("block"), "*"))
    held = rows.join(sizes, ["bucket", "step", "main"]).select(name(F.pmod(F.xxhash64("bucket", "tid"), F.col("blocks"))).alias("block"), "tid", "root", "n", "p")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        tids, n, p = group["tid"].to_numpy(), group["n"].to_numpy(), np.stack(group["p"].to_numpy()).view(np.uint64)
        root = pd.factorize(group["root"])[0]
        within = group["first"].iat[0] == group["second"].iat[0]
        left = group["block"].to_numpy() == group["first"].iat[0]
        x, y = np.flatnonzero(left), np.flatnonzero(left if within else ~left)
        a, b = [x[:0]], [y[:0]]
        for i in range(0, len(x), CELL):
            u = x[i : i + CELL, None]
            odd = sum(np.bitwise_count(p[u, j] ^ p[y, j]).astype(np.int32) for j in range(PARITIES))
            alike = (root[u] != root[y]) & (np.minimum(n[u], n[y]) >= np.maximum(n[u], n[y]) * least - 1e-9) & (odd <= (n[u] + n[y]) * ((1 - least) / (1 + least)) + 1e-9)
            at, to = np.nonzero(alike & (u < y) if within else alike)
            a.append(x[i + at])
            b.append(y[to])
        return pd.DataFrame({"a": tids[np.concatenate(a)], "b": tids[np.concatenate(b)]})

    pairs = held.join(sides, "block").groupBy("first", "second").applyInPandas(compare, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept, tid), one row per input row; ``kept`` marks the least id of each class."""
    small_batches(df.sparkSession)

    @F.pandas_udf("s array<bigint>, n int, p array<bigint>")
    def described(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_described(t) for t in texts], columns=["s", "n", "p"], index=texts.index)

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([word_hashes(x).tobytes() for x in texts])

    t = F.col(f"`{text}`").cast("string")
    rows = cut(df.select(F.col(f"`{doc_id}`").alias("id"), text_key(t).alias("tid"), described(t).alias("k")))
    nodes = rows.filter(F.col("tid").isNotNull()).groupBy("tid").agg(F.min("id").alias("rep"), F.first("k").alias("k"))
    # Each component, and a hash of it with the next, in a cycle.
    spread = nodes.select("tid", F.col("k.s").alias("s")).selectExpr(
        "tid", "inline(transform(s, (x, i) -> struct(x as bucket, xxhash64(x, s[(i + 1) % size(s)]) as two)))"
    )
    sizes = spread.groupBy("bucket").count().filter("count > 1")
    members = cut(spread.join(sizes, "bucket"))

    wanted = broadcast_if_small(members.select("tid").distinct())
    texts = df.select(t.alias("t")).withColumn("tid", text_key(F.col("t"))).join(wanted, "tid", "left_semi")
    words = cut(texts.withColumn("words", hashes("t")).groupBy("tid").agg(F.first("words").alias("words")))

    weights = members.groupBy("tid").agg(F.sum("count").alias("weight"))
    hubs = members.join(weights, "tid").groupBy("bucket").agg(F.max(F.struct("weight", "tid")).alias("h")).select("bucket", F.col("h.tid").alias("hub"))
    stars = members.select("bucket", "tid").join(hubs, "bucket").filter("tid <> hub")
    n = members.count()  # sets the number of files of links only
    links = _links(stars.select(F.col("tid").alias("a"), F.col("hub").alias("b")).distinct(), words, least, n)
    roots = components(links)

    rooted = _rooted(members, roots)
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
    bounds = nodes.select("tid", F.col("k.n").alias("n"), F.col("k.p").alias("p"))
    left = cut(rooted.join(mixed, "bucket").filter("count > 2").join(bounds, "tid"))
    key = F.when(F.col("count") <= CELL, F.col("bucket")).otherwise(F.col("two"))
    second = _links(_pairs(left.select(key.alias("key"), "tid", "root", "n", "p").dropDuplicates(["key", "tid"]), least), words, least, n)
    roots = _linked(roots, second)

    large = left.filter(F.col("count") > CELL).select("bucket", "tid", "n", "p")
    if not large.isEmpty():
        rest = _rest(_rooted(large, roots).select("bucket", "tid", "root", "n", "p"), least)
        roots = _linked(roots, _links(rest, words, least, n))

    named = nodes.select("tid", "rep").join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    names = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = named.join(names, "root").select("tid", "class_id")
    out = rows.select("id", "tid").join(classes, "tid", "left")
    class_id = F.when(F.col("tid").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select(F.col("id").alias(doc_id), class_id.alias("class_id"), F.coalesce(F.col("id") == class_id, F.lit(False)).alias("kept"), "tid")
