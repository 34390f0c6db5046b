"""Repeated passages of lines: every repeated run of two or more lines, or content-defined chunks only.

``dedup_runs`` takes every pair of adjacent lines as a key, so no run of lines is missed wherever it is shifted: a pair
that stands at an earlier place (least doc_id, then least place in the text) is removed there where it is not the first.
Pairs that overlap are removed as one range. A place that shares a line with the first place of its own pair is kept, and
the first place of each line always is. Single lines are no passage. Lines with equal hashes are held to be equal only
if their bytes are.

``dedup_lines`` removes only whole chunks, which is less: a chunk at the edge of a repeated run holds lines of its
neighbours and is kept. Its rules are these.

Lines are hashed, and a rolling hash over the last ``ROLL`` line hashes decides where a chunk ends, so an insertion moves
only the boundaries near it. A chunk ends after a line whose rolling hash is 0 modulo ``EVERY``, and after ``MOST`` lines.
Of a chunk of at least two lines that stands in more than one place, the first place (least doc_id, then least place in
the text) keeps it and the others lose it. Chunks with equal hashes are held to be equal only if their bytes are: the
least and the greatest text of a hash are compared, and where they differ, the hash is split by text.

A row is known by its id and its text, not by its place, so passes over the input agree however it is split or read again.
Rows that repeat both are one row: one of the copies keeps what that row keeps, and the others lose every line if they have
two or more.

Defined results: null texts have no lines and stay null; an empty text is one empty line; a text all of whose chunks are
removed becomes empty; rows with null ids come last; ties between rows of one id go to the lesser hash of the text; an empty
table gives an empty one; very long texts take time and memory in proportion; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import BROADCAST_ROWS, broadcast_if_small, cut

ROLL, EVERY, MOST, LEAST_LINES = 2, 3, 32, 2
#: Weights of the lines in the rolling hash, the newest first.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def chunk_ends(lines: list[str]) -> list[int]:
    """Where chunks end: for each, the number of lines up to and with its last."""
    n = len(lines)
    if not n:
        return []
    h = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, n)
    rolled = np.zeros(n, np.uint64)
    for i in range(ROLL):
        rolled[i:] += h[: n - i] * FACTORS[i]
    ends, start = [], 0
    for i in np.flatnonzero((rolled >> np.uint64(20)) % np.uint64(EVERY) == 0).tolist() + [n - 1]:
        while i - start >= MOST:
            start += MOST
            ends.append(start)
        if i >= start:
            start = i + 1
            ends.append(start)
    return ends


def chunks(text: str | None) -> list[tuple[int, int, str]]:
    """(first line, number of lines, text) of each chunk; a chunk's text ends with a line feed unless it is the last."""
    if text is None:
        return []
    lines = text.split("\n")
    out, start = [], 0
    for end in chunk_ends(lines):
        out.append((start, end - start, "\n".join(lines[start:end]) + ("\n" if end < len(lines) else "")))
        start = end
    return out


def _key(lines: str) -> bytes:
    """Hash of a chunk, whether or not it stands at the end of its text."""
    return hashlib.blake2b(lines.removesuffix("\n").encode("utf-8", "surrogatepass"), digest_size=16).digest()


CHUNK = "row binary, id long, at int, n_lines int, key binary"


def _chunk_rows(rows: DataFrame, with_text: bool) -> DataFrame:
    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row", "id", "at", "n_lines", "key"] + ["words"] * with_text
        for frame in frames:
            for start in range(0, len(frame), 500):
                part, out = frame.iloc[start : start + 500], []
                for row, own, text in zip(part["row"], part["id"], part["t"], strict=True):
                    for at, n, lines in chunks(text):
                        if n >= LEAST_LINES:
                            out.append((row, None if pd.isna(own) else own, at, n, _key(lines), *[lines.removesuffix("\n")] * with_text))
                made = pd.DataFrame(out, columns=names)
                made["id"] = made["id"].astype("Int64")
                yield made

    return rows.mapInPandas(explode, CHUNK + (", words string" if with_text else ""))


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, id, t) of the input: ``row`` is a hash of id and text."""
    i, t = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")
    known = F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("-")), F.coalesce(F.xxhash64(t).cast("string"), F.lit("-")), F.xxhash64(t, F.lit(1)).cast("string"), t.isNull().cast("string"))
    return df.select(F.unhex(F.md5(known)).alias("row"), i.alias("id"), t.alias("t"))


def _once(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Each row once, and (row, id, t, spare) of those that stand more than once, ``spare`` times more; None if none does."""
    copies = cut(rows.groupBy("row").count().filter("count > 1").select("row", (F.col("count") - 1).alias("spare")))
    if copies.isEmpty():
        return rows, None
    small = broadcast_if_small(copies)
    held = rows.join(small.select("row"), "row", "left_semi").groupBy("row").agg(F.first("id").alias("id"), F.first("t").alias("t"))
    return rows.join(small.select("row"), "row", "left_anti").unionByName(held), held.join(small, "row")


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("x"), F.col("id"), F.col("row"), F.col("at"))


REST = "text string, n_removed long, removed string"


def _assembled(rows: DataFrame, gone: DataFrame, spare: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """The rows without the ranges (row, gone: array of first and length, ascending) and, of copies, without any of two or more lines."""

    @F.pandas_udf(REST)
    def rest(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for t, removed in zip(texts, ranges, strict=True):
            if t is None or removed is None:
                out.append((None, 0, ""))
                continue
            lines, kept, n, end, names = t.split("\n"), [], 0, 0, []
            for r in removed:
                kept += lines[end : r["first"]]
                end = r["first"] + r["length"]
                n += r["length"]
                names.append(f"{r['first']}+{r['length']}")
            out.append(("\n".join(kept + lines[end:]), n, ",".join(names)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in REST.split(", ")])

    n_lines = F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n"))).cast("long")
    met = rows.join(broadcast_if_small(cut(gone)), "row", "left")
    # Only texts that lose something go through Python.
    met = met.withColumn("rest", rest(F.when(F.col("gone").isNotNull(), F.col("t")), "gone"))
    out = met.select(
        F.col("id").alias(doc_id), F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.col("rest.text")).alias(text), n_lines.alias("n_lines"), F.col("rest.n_removed").alias("n_removed"), F.col("rest.removed").alias("removed")
    )
    if spare is None:
        return out
    whole = n_lines >= 2
    copies = spare.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("spare").cast("int")))).select(
        F.col("id").alias(doc_id), F.when(whole, F.lit("")).otherwise(F.col("t")).alias(text), n_lines.alias("n_lines"), F.when(whole, n_lines).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, F.concat(F.lit("0+"), n_lines.cast("string"))).otherwise("").alias("removed"),
    )
    return out.unionByName(copies)


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """(row, at, n_lines) of each chunk to remove from rows (row, id, t), each of which stands once."""
    narrow = cut(_chunk_rows(rows, False))
    often = cut(narrow.groupBy("key").count().filter("count > 1").select("key"))
    places = narrow.join(broadcast_if_small(often), "key")
    # Bytes are compared by the least and greatest text of each hash, combined before they are shuffled.
    words = _chunk_rows(rows, True).join(broadcast_if_small(often), "key")
    spans = words.groupBy("key").agg(F.min("words").alias("least"), F.max("words").alias("most"))
    clash = cut(spans.filter(F.col("least") != F.col("most")).select("key"))
    if clash.isEmpty():
        places = places.withColumn("words", F.lit(None).cast("string"))
    else:
        split = words.join(broadcast_if_small(clash), "key").select("row", "at", "words")
        places = places.join(split, ["row", "at"], "left")
    first = places.groupBy("key", "words").agg(F.min(_order()).alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = F.col("a.words").eqNullSafe(F.col("b.words"))
    met = places.alias("a").join(first.alias("b"), (F.col("a.key") == F.col("b.key")) & same)
    lost = met.filter((F.col("a.row") != F.col("b.first.row")) | (F.col("a.at") != F.col("b.first.at")))
    return lost.select(F.col("a.row").alias("row"), F.col("a.at").alias("at"), F.col("a.n_lines").alias("n_lines"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_removed, removed): the text without its repeated chunks, one row per input row.

    ``removed`` lists the removed ranges as ``first+lines``, comma-joined, lines counted from 0.
    """
    rows, spare = _once(_rows(df, doc_id, text))
    lost = repeated_chunks(rows)
    gone = lost.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("first"), F.col("n_lines").alias("length")))).alias("gone"))
    return _assembled(rows, gone, spare, doc_id, text)


def _pairs(rows: DataFrame) -> DataFrame:
    """(row, id, at, a, b): the hashes of each two adjacent lines, and the place of the first."""
    n = F.size("h") - 1
    hashed = rows.select("row", "id", F.transform(F.split("t", "\n"), lambda x: _line_hash(x)).alias("h")).filter(n > 0)
    pairs = F.arrays_zip(F.slice("h", F.lit(1), n).alias("a"), F.slice("h", F.lit(2), n).alias("b"))
    return hashed.select("row", "id", F.posexplode(pairs).alias("at", "p")).select("row", "id", "at", "p.a", "p.b")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def repeated_pairs(rows: DataFrame) -> DataFrame:
    """(row, at) of each pair of adjacent lines that stands at an earlier place, of rows (row, id, t), each of which stands once."""
    pairs = _pairs(rows)
    often = broadcast_if_small(cut(pairs.groupBy("a", "b").count().filter("count > 1").select("a", "b")))
    places = pairs.join(often, ["a", "b"])
    # Bytes are compared by the least and greatest line of each hash, combined before they are shuffled.
    hashes = broadcast_if_small(often.select(F.explode(F.array("a", "b")).alias("h")).distinct(), 2 * BROADCAST_ROWS)
    lines = rows.select("row", F.posexplode(F.split("t", "\n")).alias("at", "line")).withColumn("h", _line_hash(F.col("line")))
    spans = lines.join(hashes, "h").groupBy("h").agg(F.min("line").alias("least"), F.max("line").alias("most"))
    clash = cut(spans.filter(F.col("least") != F.col("most")).select("h"))
    if clash.isEmpty():
        places = places.withColumn("one", F.lit(None).cast("string")).withColumn("two", F.lit(None).cast("string"))
    else:
        split = lines.join(broadcast_if_small(clash), "h").select("row", "at", "line")
        places = places.join(split.withColumnRenamed("line", "one"), ["row", "at"], "left")
        places = places.join(split.select("row", (F.col("at") - 1).alias("at"), F.col("line").alias("two")), ["row", "at"], "left")
    first = places.groupBy("a", "b", "one", "two").agg(F.min(_order()).alias("first"), F.count("*").alias("n")).filter("n > 1")
    p, f = places.alias("p"), broadcast_if_small(cut(first)).alias("f")
    same = F.col("p.one").eqNullSafe(F.col("f.one")) & F.col("p.two").eqNullSafe(F.col("f.two"))
    met = p.join(f, (F.col("p.a") == F.col("f.a")) & (F.col("p.b") == F.col("f.b")) & same)
    lost = met.filter((F.col("p.row") != F.col("f.first.row")) | (F.col("p.at") > F.col("f.first.at") + 1))
    return lost.select(F.col("p.row").alias("row"), F.col("p.at").alias("at"))


def dedup_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_removed, removed): the text without its repeated runs of two or more lines, one row per input row.

    ``removed`` lists the removed ranges as ``first+lines``, comma-joined, lines counted from 0; ranges do not touch.
    """
    rows, spare = _once(_rows(df, doc_id, text))
    lost = repeated_pairs(rows).groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("at"))
    # A range begins where the pair before ends above it, and ends where the next pair begins below it.
    begins = F.filter("at", lambda x, i: (i == 0) | (x - F.get("at", i - 1) > 2))
    ends = F.transform(F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) - x > 2)), lambda x: x + 2)
    ranges = F.zip_with(begins, ends, lambda x, y: F.struct(x.alias("first"), (y - x).alias("length")))
    return _assembled(rows, lost.select("row", ranges.alias("gone")), spare, doc_id, text)
