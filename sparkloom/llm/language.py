"""Language identification by hyperdimensional profiles.

Each letter has a random vector of ``DIMS`` signs, drawn from a hash of the letter. A trigram's vector is the
product of its letters' vectors, the first rotated twice and the second once, so order counts. A text bundles
(adds) the vectors of its trigrams; a language's prototype bundles the texts it is learned from. A text takes
the language whose prototype has the largest cosine with it.

Only letters count, in lower case; anything else is one blank between words. Learning uses at most about
``per_lang`` texts of each language, those with the least hash of their id, so that a language's prototype
does not depend on how the table is partitioned. Bundles are sums of whole numbers: exact in any order.

Defined results: a null text and one without letters get ``und`` and score 0; so does every text if nothing
could be learned; ties go to the language that sorts first; the score is the cosine, 0 if negative; repeated
rows each get their own result; very long texts are read in pieces; columns beside those named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches

DIMS, PER_LANG, SEED = 1024, 4000, "letters-1"
UNKNOWN = "und"
#: Characters read at once, and trigram vectors held at once.
PIECE, BLOCK = 300_000, 2048
BLANK = 0x20


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a blank."""
    points = np.arange(0x110000, dtype=np.uint32)
    text = points[:0xD800].tobytes().decode("utf-32-le")
    is_letter = np.zeros(0x110000, bool)
    is_letter[:0xD800] = [c.isalpha() for c in text]
    is_letter[0xE000:0x110000] = [chr(c).isalpha() for c in range(0xE000, 0x110000)]
    return np.where(is_letter, points, BLANK).astype(np.uint32)


@functools.lru_cache(maxsize=1 << 12)
def _letter_vector(point: int, dims: int) -> np.ndarray:
    raw = hashlib.shake_256(f"{SEED}|{point}".encode()).digest(dims // 8)
    return (np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.int8) * 2 - 1).astype(np.int8)


def _trigram_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """A row of signs for each trigram code (three code points of 21 bits)."""
    parts = [(codes >> 42) & 0x1FFFFF, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF]
    points, at = np.unique(np.concatenate(parts), return_inverse=True)
    table = np.stack([_letter_vector(int(p), dims) for p in points])
    a, b, c = at.reshape(3, -1)
    return (np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]).astype(np.float32)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Trigram codes of a text, piece by piece; words stand between single blanks."""
    carry = np.array([BLANK], np.int64)
    letters = _letters()
    for start in range(0, len(text), PIECE):
        points = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        symbols = np.concatenate([carry, letters[points].astype(np.int64)])
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK)
        symbols = symbols[keep]
        if start + PIECE >= len(text) and symbols[-1] != BLANK:
            symbols = np.append(symbols, BLANK)
        if len(symbols) > 2:
            yield (symbols[:-2] << 42) | (symbols[1:-1] << 21) | symbols[2:]
        carry = symbols[-2:]


def bundle(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """A row of sums for each text; all zero where there is no letter."""
    out = np.zeros((len(texts), dims), np.float64)
    rows: list[np.ndarray] = []
    codes: list[np.ndarray] = []

    def flush() -> None:
        if not codes:
            return
        found, at = np.unique(np.concatenate(codes), return_inverse=True)
        row = np.concatenate(rows)
        used, row = np.unique(row, return_inverse=True)
        for start in range(0, len(found), BLOCK):
            inside = (at >= start) & (at < start + BLOCK)
            width = min(BLOCK, len(found) - start)
            counts = np.bincount(row[inside] * width + at[inside] - start, minlength=len(used) * width).reshape(len(used), width)
            out[used] += counts.astype(np.float32) @ _trigram_vectors(found[start : start + BLOCK], dims)
        rows.clear()
        codes.clear()

    held = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text or ""):
            rows.append(np.full(len(piece), i))
            codes.append(piece)
            held += len(piece)
            if held >= PIECE:
                flush()
                held = 0
    flush()
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: its id's CRC-32, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, dims: int = DIMS) -> dict[str, np.ndarray]:
    """Prototype of each language: one row of ``dims`` sums for each language reaches the driver."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("id")))
    sizes = rows.groupBy("l").count()
    # Of a language with n texts, those whose hash is among the first per_lang / n of all hashes.
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.col("t"))), 1, 8), 16, 10).cast("double") / float(2**32)
    sample = rows.join(F.broadcast(sizes), "l").filter(draw * F.col("count") < per_lang).select("l", "t")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for name, part in frame.groupby("l"):
                total[name] = total.get(name, 0) + bundle(part["t"].tolist(), dims).sum(axis=0)
        if total:
            yield pd.DataFrame({"l": list(total), "v": [v.astype(np.int64) for v in total.values()]})

    parts = sample.mapInPandas(sums, "l string, v array<bigint>")
    totals = parts.select("l", F.posexplode("v").alias("at", "x")).groupBy("l", "at").agg(F.sum("x").alias("x"))
    found = totals.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    return {r["l"]: np.array([x["x"] for x in r["v"]], np.float64) for r in sorted(found, key=lambda r: r["l"])}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the language and score of each text."""
    small_batches(df.sparkSession)
    names = sorted(n for n, v in prototypes.items() if np.any(v))
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]) if names else np.zeros((0, 1))
    dims = unit.shape[1]

    @F.pandas_udf("l string, s double")  # marked below, so that a filter on its result does not run it twice
    def best(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for start in range(0, len(texts) if names else 0, 512):
            vectors = bundle(texts.iloc[start : start + 512].tolist(), dims)
            norms = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ unit.T / np.maximum(norms, 1e-12)[:, None]
            for i, top in enumerate(cosines.argmax(axis=1)):
                if norms[i] > 0:
                    langs[start + i] = names[top]
                    scores[start + i] = min(1.0, max(0.0, round(float(cosines[i, top]), 9)))
        return pd.DataFrame({"l": langs, "s": scores})

    found = best.asNondeterministic()(F.col(f"`{text}`").cast("string"))
    return df.withColumn("lang_found", found).withColumn(out, F.col("lang_found.l")).withColumn(score, F.col("lang_found.s")).drop("lang_found")


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row."""
    prototypes = learn(df, doc_id, text, lang, per_lang)
    rows = df.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias("lang_text"))
    return predict(rows.withColumn("held_out", held_out(F.col(doc_id))), prototypes, "lang_text").drop("lang_text").select(doc_id, "held_out", "lang_pred", "score")


def plain_crc32(doc_id: int) -> int:
    """CRC-32 of an id as text, as the rule for held-out documents has it."""
    return zlib.crc32(str(doc_id).encode())
