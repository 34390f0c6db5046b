"""Benchmark decontamination by winnowing.

Words are hashed, each run of ``GRAM`` words becomes a k-gram hash, and of every ``window - GRAM + 1``
consecutive k-grams the least is kept. Two texts that share ``window`` words in a row therefore share a
kept k-gram at the same place of the shared span. Kept k-grams of documents are joined with those of
the benchmark, and each hit is extended: the windows around it are compared word for word.

Items of fewer words than a window have one window, of all their words; documents are searched for
those lengths by the hash of every run of that many words, and compared in the same way.

The k-grams of documents stream through a broadcast join with the benchmark's kept hashes, in slices of
bounded size, and are never shuffled; only those that meet a kept hash are tested for being kept themselves.

Defined results: null texts and texts without words have no words, no hits and no items; repeated rows
each get their own result; an item that occurs twice counts once; items with null ids are searched, count
in ``n_hit``, but carry no id; an empty benchmark leaves every document clean; ties between equal k-grams keep all of
them; very long texts take time and memory in proportion to their words; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import BROADCAST_ROWS

WINDOW, GRAM = 10, 5
#: Upper and lower case, and what stands between words once A-Z are lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most kept hashes that are broadcast at once; a larger benchmark is joined in as many slices as it needs.
KEPT_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words in order. Splitting takes linear time; extracting all matches would copy the text for each."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _run_hash(hashes: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` word hashes from position ``at`` (from 0)."""
    return F.xxhash64(F.lit(length), *[F.get(hashes, at + j) for j in range(length)])


def _runs(hashes: Column, length: int) -> Column:
    """Hash of each run of ``length`` words; none if there are fewer words."""
    last = F.size(hashes) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _run_hash(hashes, i, length))).otherwise(
        F.array().cast("array<bigint>")
    )


def _is_least(grams: Column, at: Column, span: int, first: Column | int = 0, last: Column | None = None) -> Column:
    """Whether the k-gram at ``at`` is the least of some ``span`` consecutive ones between ``first`` and ``last``.

    Only single elements are read: a slice would copy the whole array each time.
    """
    last = F.size(grams) - 1 if last is None else last
    own = F.get(grams, at)
    fits = {d: F.coalesce((at + d >= first) & (at + d <= last) & (F.get(grams, at + d) >= own), F.lit(False)) for d in range(1 - span, span)}
    windows = [functools.reduce(Column.__and__, [fits[d] for d in range(low, low + span)]) for low in range(1 - span, 1)]
    return functools.reduce(Column.__or__, windows)


def _words_at(at: Column, n: Column, most: int) -> Column:
    """The ``n`` words of ``w`` at a place, at most ``most``."""
    return F.concat_ws(" ", *[F.when(n > j, F.get("w", at + j)) for j in range(most)])


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(n, run, words, item_id): the distinct windows of each item; ``run`` is the hash of the window."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), words_of(F.col(f"`{text}`").cast("string")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    starts = items.select("item_id", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("s"))
    return starts.select("n", F.array_join(F.slice("w", F.col("s"), F.col("n")), " ").alias("words"), "item_id").distinct()


def _kept_of_items(benchmark: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """(n, kept): winnowed k-grams of the items as long as a window, whole hashes of the shorter ones."""
    items = benchmark.select(F.transform(words_of(F.col(f"`{text}`").cast("string")), lambda w: F.xxhash64(w)).alias("h"))
    items = items.select(F.size("h").alias("size"), "h", _runs(F.col("h"), gram).alias("g"))
    long = F.filter(F.transform("g", lambda x, i: F.when(_is_least(F.col("g"), i, window - gram + 1), x)), lambda x: x.isNotNull())
    short = F.coalesce(*[F.when(F.col("size") == n, F.array(_run_hash(F.col("h"), F.lit(0), n))) for n in range(1, window)])
    kept = items.select(F.least("size", F.lit(window)).alias("n"), F.explode(F.when(F.col("size") >= window, long).otherwise(short)).alias("kept"))
    return kept.distinct()


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document.

    One pass over the documents and one shuffle of narrow rows by document. The benchmark's windows are
    broadcast if there are at most ``BROADCAST_ROWS`` of them, and shuffled otherwise.
    """
    span = window - gram + 1
    kept = _kept_of_items(benchmark, item_text, window, gram)
    facts = kept.groupBy("n").count().collect()  # a row for each length, so at most `window` rows
    lengths = sorted(r["n"] for r in facts)
    slices = max(1, -(-sum(r["count"] for r in facts) // KEPT_ROWS))
    windows = benchmark_windows(benchmark, item_id, item_text, window)

    base = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias(doc_id), words_of(F.col(f"`{text}`").cast("string")).alias("w")
    )
    base = base.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    # The runs of each length one after another, then a null, which keeps every document in the join below.
    runs = [_runs(F.col("h"), gram if n == window else n) for n in lengths]
    base = base.withColumn("g", F.concat(*runs, F.array(F.lit(None).cast("bigint"))))
    grams = base.select("row", doc_id, "w", "g", F.posexplode_outer("g").alias("at", "kept"))
    n, start = F.lit(None).cast("int"), F.lit(0)
    for length in lengths:
        n = F.when(F.col("at") >= start, F.lit(length)).otherwise(n)
        start = start + F.greatest(F.size("w") - (gram if length == window else length) + 1, F.lit(0))
    first, start = F.lit(0), F.lit(0)
    for length in lengths:
        first = F.when(F.col("at") >= start, start).otherwise(first)
        start = start + F.greatest(F.size("w") - (gram if length == window else length) + 1, F.lit(0))
    long = F.col("n") == window
    place = F.col("at") - F.col("first")
    least = _is_least(F.col("g"), F.col("at"), span, F.col("first"), F.col("first") + F.size("w") - gram)
    places = F.when(long & (F.size("w") >= window) & least, F.sequence(F.greatest(place - (span - 1), F.lit(0)), F.least(place, F.size("w") - window))).when(~long, F.array(place))
    tried = None
    for i in range(slices):
        part = kept if slices == 1 else kept.filter(F.pmod("kept", F.lit(slices)) == i)
        met = grams.join(F.broadcast(part.select("kept", F.col("n").alias("of"))), "kept", "left").withColumn("n", n)
        met = met.filter((F.col("of") == F.col("n")) | (F.col("kept").isNull() if i == 0 else F.lit(False))).withColumn("first", first)
        met = met.select("row", doc_id, "w", "n", F.explode_outer(F.when(F.col("of").isNotNull(), places)).alias("at"))
        words = F.when(F.col("at").isNotNull(), _words_at(F.col("at"), F.col("n"), window))
        met = met.select("row", doc_id, F.size("w").cast("long").alias("n_words"), "at", F.when(F.col("at").isNotNull(), F.col("n")).alias("n"), words.alias("words"))
        tried = met if tried is None else tried.union(met)

    windows = F.broadcast(windows) if windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else windows
    hits = tried.join(windows.withColumn("hit", F.lit(True)), ["n", "words"], "left")
    grouped = hits.groupBy("row", doc_id, "n_words").agg(
        F.collect_set(F.when(F.col("hit"), F.struct("at", "n"))).alias("spans"), F.collect_set(F.when(F.col("hit"), F.col("item_id"))).alias("items")
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["total"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(acc["end"], x["at"]))).alias("total"), F.greatest(acc["end"], x["at"] + x["n"]).alias("end")
        ),
        lambda acc: acc["total"],
    ).cast("long")
    return grouped.select(doc_id, "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")).withColumn(
        "contaminated", F.col("n_hit") > 0
    )
