"""Document quality by hierarchical empirical Bayes.

A logistic classifier, learned from labelled documents, gives each document's own evidence. Documents are summed by path
and by host; a host's share of good documents is shrunk toward the global one, and a path's toward its host's, each with
the strength that the spread between them supports (method of moments), so sparse sites stay near their prior. The score
adds the path's log odds, less the global log odds, to the document's.

Host and path are columns: by default ``source``, and ``source`` with ``lang``. The classifier learns from at most about
``max_labels`` labelled documents, those with the least hash of their ids; sums and posteriors cover every document.

Defined results: a null text is an empty one; null hosts and paths are named ``-``; without labels of both kinds the
classifier knows nothing, and scores are the sites' only; of several labels of one document the greatest counts; repeated
rows each get their own result, and each counts; a score of just 0.5 is kept; an empty table gives an empty one; very long
texts are measured whole, in memory in proportion; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import broadcast_if_small, cut, small_batches

MAX_LABELS, ROUNDS, RIDGE = 20_000, 30, 1.0
#: A document's own probability is kept this far from 0 and 1 before it is summed; strengths are kept within bounds.
EDGE, LEAST_STRENGTH, MOST_STRENGTH = 0.01, 2.0, 1000.0
#: How much of a site's log odds is added to its documents'.
SITE_WEIGHT = 0.5
SYMBOLS = "#$%&*|@^~<>{}[]\\_=+!"
FEATURES = 14


def features(text: str | None) -> np.ndarray:
    """Shares and means that need no vocabulary; all finite, near unit size."""
    text = text or ""
    n = len(text)
    if not n:
        return np.zeros(FEATURES)
    words, lines = text.split(), text.split("\n")
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ascii_counts = np.bincount(points[points < 128], minlength=128)
    upper, lower = ascii_counts[65:91].sum(), ascii_counts[97:123].sum() + (points >= 192).sum()
    symbols = sum(ascii_counts[ord(c)] for c in SYMBOLS)
    distinct, distinct_lines = len(set(words)), len(set(lines))
    share = ascii_counts[ascii_counts > 0] / n
    return np.array([
        np.log1p(n) / 10, np.log1p(len(words)) / 8, upper / n, lower / n, symbols / n * 5, ascii_counts[48:58].sum() / n * 5, ascii_counts[32] / n * 3,
        n / max(1, len(words)) / 10, distinct / max(1, len(words)), distinct_lines / len(lines), np.log1p(n / len(lines)) / 6,
        (ascii_counts[33] + ascii_counts[63]) / max(1, len(words)), ascii_counts[124] / max(1, len(words)), -(share * np.log(share)).sum() / 4,
    ])


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, squares of the features included; zeros if only one class is there."""
    z = expand(x)
    beta = np.zeros(z.shape[1])
    if len(y) == 0 or y.min() == y.max():
        return beta
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(z.shape[1]) * 1e-2, z.T @ (y - p) - RIDGE * 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def expand(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x, x**2])


def _odds(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _strength(sums: DataFrame, prior: Column) -> Column:
    """Beta strength by moments: what of the spread of shares is more than chance, over units of at least two."""
    share, var = F.col("good") / F.col("n"), prior * (1 - prior)
    seen = F.col("n") > 1
    spread = F.sum(F.when(seen, F.col("n") * F.pow(share - prior, 2)))
    chance = F.sum(F.when(seen, var))
    weight = F.sum(F.when(seen, F.col("n") * var))
    rho = F.greatest((spread - chance) / F.nullif(weight - chance, F.lit(0.0)), F.lit(1e-9))
    return F.least(F.greatest(F.coalesce(1 / rho - 1, F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def score_quality(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", host: Column | None = None, path: Column | None = None, max_labels: int = MAX_LABELS
) -> DataFrame:
    """(doc_id, host, path, doc_score, host_share, path_share, score, kept), one row per input row."""
    small_batches(documents.sparkSession)
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("-")), F.coalesce(F.col("lang").cast("string"), F.lit("-"))) if path is None else path
    rows = documents.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"), F.coalesce(host.cast("string"), F.lit("-")).alias("host"), F.coalesce(path.cast("string"), F.lit("-")).alias("path")
    )
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    total = known.count()
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / float(2**32)
    sample = F.broadcast(known.filter(draw * total < max_labels))  # about max_labels rows of two numbers

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"y": frame["y"], "x": [features(t).tolist() for t in frame["t"]]})

    seen = rows.select("id", "t").join(sample, "id").select("y", "t").mapInPandas(measure, "y double, x array<double>").collect()
    seen = sorted((r["y"], r["x"]) for r in seen)
    beta = fit(np.array([x for _, x in seen]).reshape(len(seen), FEATURES), np.array([y for y, _ in seen]))

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        return pd.Series(np.round(expand(np.stack([features(t) for t in texts])) @ beta, 6) if len(texts) else [])

    scored = cut(rows.select("id", "host", "path", margin("t").alias("margin")))
    p = F.least(F.greatest(1 / (1 + F.exp(-F.col("margin"))), F.lit(EDGE)), F.lit(1 - EDGE))
    scored = scored.withColumn("p", F.round(p, 9))
    by_path = cut(scored.groupBy("host", "path").agg(F.sum(F.col("p").cast("decimal(18,9)")).cast("double").alias("good"), F.count("*").alias("n")))
    by_host = by_path.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    top = by_host.agg(F.coalesce(F.sum("good") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.5)).alias("g")).first()["g"]
    k_host = by_host.agg(_strength(by_host, F.lit(top)).alias("k")).first()["k"]
    hosts = by_host.select("host", ((F.col("good") + k_host * top) / (F.col("n") + k_host)).alias("host_share"))
    paths = by_path.join(hosts, "host")
    k_path = paths.agg(_strength(paths, F.col("host_share")).alias("k")).first()["k"]
    paths = paths.select("host", "path", "host_share", ((F.col("good") + k_path * F.col("host_share")) / (F.col("n") + k_path)).alias("path_share"))
    joined = scored.join(broadcast_if_small(paths), ["host", "path"])
    logit = F.col("margin") + SITE_WEIGHT * (_odds(F.col("path_share")) - _odds(F.lit(top)))
    score = F.round(1 / (1 + F.exp(-logit)), 6)
    return joined.select(
        F.col("id").alias(doc_id), "host", "path", F.round(1 / (1 + F.exp(-F.col("margin"))), 6).alias("doc_score"), F.round("host_share", 6).alias("host_share"), F.round("path_share", 6).alias("path_share"), score.alias("score"), (score >= 0.5).alias("kept")
    )
