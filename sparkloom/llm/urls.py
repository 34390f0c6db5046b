"""URL verdicts: host and path rules first, then gradient-boosted trees on lexical features.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there up to
``?``, ``#`` or the end. A url that is null or has no ``://`` has neither.

A rule is (suffix of the host, start of the path, verdict). It fits its host and every subdomain; of the rules that
fit, the longest wins. Where none fits, the trees decide. They are learned from labelled urls, by default those that a
rule labels, and see the url only through features: lengths, depth, share of digits, entropy, counts of parameters,
and how often urls of the same suffix were blocked. Those statistics are counted over all labelled rows and joined to the
urls; the trees learn from statistics without the url's own fold, one of ``FOLDS`` by its hash, so that no url tells them its
own label. Only the trees learn from a sample, of at most ``max_rows`` distinct urls: a url enters with a chance in proportion
to its rows, by its hash, and for certain if it has more than a share of them; its weight makes up for the chance. If chance
gives more, those of greatest weight and then of least hash stay, so nothing is cut by name.

Defined results: without two classes to learn from, the trees give the class there is, or ``allow`` if there is none; a score
of just 0.5 blocks; repeated rows each get their own result; an empty table gives an empty one; very long urls are read
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import broadcast_if_small, cut, small_batches

ALLOW, BLOCK = "allow", "block"
#: The rules of the standard query: host and path, and the verdict.
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))
MAX_ROWS, TREES, DEPTH, RATE, BINS, SMOOTHING = 20_000, 40, 3, 0.2, 32, 20.0
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SHAPE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_share", "entropy", "parameters", "query_length", "labels", "hyphens", "secure", "suffix_blocked", "site_blocked")


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    _, counts = np.unique(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), return_counts=True)
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def suffixes(host: str) -> tuple[str, str]:
    """The last label, and the last two."""
    labels = host.rsplit(".", 2)
    return labels[-1], ".".join(labels[-2:])


def lexical(url: str, host: str, path: str) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), path.count("/"), digits / max(1, len(url)), _entropy(url), query.count("=") if query else 0, len(query),
        host.count(".") + 1, url.count("-"), float(url.startswith("https")),
    ]


@dataclass
class Model:
    """Trees as arrays of (feature, threshold, left, right, value), and the statistics of suffixes."""

    prior: float = 0.0
    base: float = -1.0
    trees: list[list[tuple]] = field(default_factory=list)
    suffix: dict[str, float] = field(default_factory=dict)

    def features(self, urls: list[str], hosts: list[str], paths: list[str], rates: list[tuple[float, float]] | None = None) -> np.ndarray:
        """``rates`` are the suffix statistics of each url, by default those of ``suffix``."""
        if rates is None:
            rates = [tuple(self.suffix.get(name, self.prior) for name in suffixes(host)) for host in hosts]
        rows = []
        for url, host, path, rate in zip(urls, hosts, paths, rates, strict=True):
            rows.append([*lexical(url, host, path), *rate])
        return np.array(rows, float).reshape(len(rows), len(FEATURES))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            feature, threshold, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                goes_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            out += value[at]
        return out


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, tree: list) -> int:
    """Adds the best subtree for ``rows`` and returns its place."""
    place = len(tree)
    g, h = grad[rows].sum(), hess[rows].sum()
    tree.append((-1, 0.0, 0, 0, RATE * g / (h + 1.0)))
    best, cut = 1e-9, None
    if depth < DEPTH and len(rows) > 1:
        for f in range(binned.shape[1]):
            left_g = np.cumsum(np.bincount(binned[rows, f], grad[rows], BINS + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], hess[rows], BINS + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g * g / (h + 1)
            top = int(gain[: len(edges[f])].argmax()) if len(edges[f]) else 0
            if len(edges[f]) and gain[top] > best:
                best, cut = gain[top], (f, top)
    if cut:
        f, top = cut
        goes_left = binned[rows, f] <= top
        left = _grow(binned, edges, grad, hess, rows[goes_left], depth + 1, tree)
        right = _grow(binned, edges, grad, hess, rows[~goes_left], depth + 1, tree)
        tree[place] = (f, float(edges[f][top]), left, right, 0.0)
    return place


def _quantiles(values: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lower quantiles of values that stand ``weights`` times each."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    places = np.searchsorted(upto, np.floor(at * (upto[-1] - 1)), side="right")
    return values[order][np.minimum(places, len(values) - 1)]


def fit(
    urls: list[str], hosts: list[str], paths: list[str], blocked: list[bool], weights: list[float] | None = None, rates: list[tuple[float, float]] | None = None, prior: float | None = None
) -> Model:
    """Logistic boosting with histograms; the same rows in any order give the same trees up to rounding.

    ``rates`` and ``prior`` are statistics of more rows than these; by default they are counted on these.
    """
    y = np.array(blocked, float)
    w = np.ones(len(y)) if weights is None else np.array(weights, float)
    model = Model(prior=prior if prior is not None else float((y * w).sum() / w.sum()) if len(y) else 0.0)
    if len(y) == 0 or y.min() == y.max():
        model.base = 1.0 if len(y) and y[0] else -1.0
        return model
    if rates is None:
        seen: dict[tuple[str, int | None], list[float]] = {}
        for url, host, b, weight in zip(urls, hosts, y, w, strict=True):
            for key in {(name, fold) for name in suffixes(host) for fold in (None, _fold(url))}:
                n = seen.setdefault(key, [0.0, 0.0])
                n[0] += b * weight
                n[1] += weight
        rate = lambda b, n: (b + SMOOTHING * model.prior) / (n + SMOOTHING)
        model.suffix = {name: rate(*n) for (name, fold), n in seen.items() if fold is None}
        rest = lambda name, fold: rate(*(a - own for a, own in zip(seen[name, None], seen[name, fold], strict=True)))
        rates = [tuple(rest(name, _fold(url)) for name in suffixes(host)) for url, host in zip(urls, hosts, strict=True)]
    x = model.features(urls, hosts, paths, rates)
    edges = [np.unique(_quantiles(x[:, f], w, np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    model.base = float(np.log(model.prior / (1 - model.prior)))
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree: list[tuple] = []
        _grow(binned, edges, w * (y - p), w * p * (1 - p), np.arange(len(y)), 0, tree)
        model.trees.append(tree)
        margin += Model(base=0.0, trees=[tree]).margin(x)
    return model


def _fold(url: str) -> int:
    return int(hashlib.md5(url.encode("utf-8", "surrogatepass")).hexdigest()[8:10], 16) % FOLDS


def fold_of(url: Column) -> Column:
    """The same as ``_fold``."""
    return F.conv(F.substring(F.md5(url), 9, 2), 16, 10).cast("int") % FOLDS


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(name, fold, b, n): blocked and all rows of each suffix in each fold, over all rows of (url, host, blocked)."""
    names = labelled.select(fold_of(F.col("url")).alias("fold"), F.explode(F.array_distinct(F.array(*_names(F.col("host"))))).alias("name"), F.col("blocked").cast("double").alias("b"))
    return names.groupBy("name", "fold").agg(F.sum("b").alias("b"), F.count("*").alias("n"))


def suffix_rates(counts: DataFrame, prior: float) -> DataFrame:
    """(name, rate): how often urls of each suffix are blocked."""
    return counts.groupBy("name").agg(((F.sum("b") + SMOOTHING * prior) / (F.sum("n") + SMOOTHING)).alias("rate"))


def with_other_rates(df: DataFrame, counts: DataFrame, prior: float) -> DataFrame:
    """``df``, which has url and host, with ``last_rate`` and ``two_rate`` over the folds that are not the url's."""
    whole = counts.groupBy("name").agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
    rest = counts.join(whole, "name").select("name", "fold", ((F.col("all_b") - F.col("b") + SMOOTHING * prior) / (F.col("all_n") - F.col("n") + SMOOTHING)).alias("rate"))
    last, two = _names(F.col("host"))
    keyed = df.withColumn("last_name", last).withColumn("two_name", two).withColumn("fold", fold_of(F.col("url")))
    for name in ("last", "two"):
        keyed = keyed.join(rest.select(F.col("name").alias(f"{name}_name"), "fold", F.col("rate").alias(f"{name}_rate")), [f"{name}_name", "fold"], "left")
    return keyed.drop("last_name", "two_name", "fold").fillna(prior, ["last_rate", "two_rate"])


def _names(host: Column) -> tuple[Column, Column]:
    """The same as ``suffixes``."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def with_rates(df: DataFrame, rates: DataFrame, prior: float) -> DataFrame:
    """``df``, which has a host, with ``last_rate`` and ``two_rate``; the prior where a suffix has no labelled url."""
    last, two = _names(F.col("host"))
    lasts = broadcast_if_small(rates.filter(~F.contains("name", F.lit("."))).select(F.col("name").alias("last_name"), F.col("rate").alias("last_rate")))
    twos = broadcast_if_small(rates.select(F.col("name").alias("two_name"), F.col("rate").alias("two_rate")))
    met = df.withColumn("last_name", last).withColumn("two_name", two).join(lasts, "last_name", "left").join(twos, "two_name", "left")
    return met.drop("last_name", "two_name").fillna(prior, ["last_rate", "two_rate"])


def sample(labelled: DataFrame, n: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """(url, host, path, n_blocked, n_rows, weight) of at most ``max_rows`` distinct urls out of ``n`` rows."""
    share = min(1.0, 0.9 * max_rows / max(1, n))
    seen = labelled.groupBy("url", "host", "path").agg(F.sum(F.col("blocked").cast("long")).alias("n_blocked"), F.count("*").alias("n_rows"))
    hashed = seen.withColumn("hash", F.md5("url")).withColumn("expected", F.col("n_rows") * share)
    draw = F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / float(2**32)
    taken = hashed.filter((F.lit(share) == 1.0) | (draw < F.col("expected"))).withColumn("weight", F.greatest(F.lit(1.0), F.col("expected")))
    return taken.orderBy(F.col("weight").desc(), "hash", "url").limit(max_rows).drop("hash", "expected")


def learn(labelled: DataFrame, max_rows: int = MAX_ROWS) -> tuple[Model, DataFrame]:
    """Trees from (url, host, path, blocked), and the rates of all suffixes in it."""
    total = labelled.agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("b")).first()
    prior = (total["b"] or 0) / max(1, total["n"])
    counts = cut(suffix_counts(labelled))
    rows = []
    for r in with_other_rates(sample(labelled, total["n"], max_rows), counts, prior).collect():  # at most max_rows
        # A url with both labels is a row of each.
        for blocked, n in ((True, r["n_blocked"]), (False, r["n_rows"] - r["n_blocked"])):
            if n:
                rows.append((r["url"], r["host"], r["path"], blocked, r["weight"] * n / r["n_rows"], (r["last_rate"], r["two_rate"])))
    rows.sort(key=lambda r: (r[0], r[3]))
    urls, hosts, paths, blocked, weights, of = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [], [])
    return fit(urls, hosts, paths, blocked, weights, of, prior), suffix_rates(counts, prior)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score), one row per input row.

    ``labelled`` has the columns url and blocked; without it the urls that a rule fits are the labelled ones.
    """
    u = F.col(f"`{url}`").cast("string")
    rows = pages.select(F.col(f"`{page_id}`").alias(page_id), u.alias("url_text"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = rows.filter(F.col("fits").isNotNull()).select(F.col("url_text").alias("url"), "host", "path", (F.col("fits.verdict") == BLOCK).alias("blocked"))
    else:
        known = labelled.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "blocked").filter(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    model, rates = learn(known, max_rows)
    small_batches(pages.sparkSession)

    @F.pandas_udf("double")
    def margin(urls: pd.Series, hosts: pd.Series, paths: pd.Series, last: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(model.margin(model.features(urls.fillna("").tolist(), hosts.tolist(), paths.tolist(), list(zip(last, two, strict=True)))))

    rows = with_rates(rows, rates, model.prior)
    scored = rows.withColumn("block_score", F.round(1 / (1 + F.exp(-margin("url_text", "host", "path", "last_rate", "two_rate"))), 6))
    by_trees = F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(page_id, "host", "path", F.col("fits.rule").alias("rule"), F.coalesce(F.col("fits.verdict"), by_trees).alias("verdict"), "block_score")
