import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.mixing import budgets, mix

SCHEMA = "doc_id long, text string, lang string, source string"


def plain_fill(total, children):
    """Water-filling by bisection: {child: (capacity, weight)} to shares."""
    total = min(total, sum(c for c, w in children.values() if w > 0))
    low, high = 0.0, 1e18
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(c, level * w) for c, w in children.values()) < total:
            low = level
        else:
            high = level
    return {k: min(c, high * w) for k, (c, w) in children.items()}


def plain_budgets(leaves, total, weights, depth=0, path=()):
    own = {p: c for p, c in leaves.items() if p[:depth] == path}

    def capacity(p):
        if weights.get(p, 1.0) <= 0:
            return 0.0
        if p in own:
            return own[p]
        return sum(capacity(q) for q in {x[: len(p) + 1] for x in own if x[: len(p)] == p})

    children = {x[: depth + 1] for x in own}
    shares = plain_fill(total, {c: (capacity(c), weights.get(c, 1.0)) for c in children})
    out = {}
    for c, b in shares.items():
        out |= {c: b} if c in own else plain_budgets(leaves, b, weights, depth + 1, c)
    return out


@pytest.mark.parametrize("total", [0, 10, 500, 900, 5000])
def test_budgets_equal_bisection(spark, total):
    leaves = {("a", "en", "s1"): 100.0, ("a", "en", "s2"): 5.0, ("a", "de", "s3"): 10.0, ("b", "en", "s4"): 700.0, ("b", "fr", "s1"): 40.0, ("c", "en", "s9"): 300.0}
    weights = {("a",): 2.0, ("a", "de"): 3.0, ("b", "fr", "s1"): 0.5, ("c", "en"): 0.0}
    df = spark.createDataFrame([(*p, c) for p, c in leaves.items()], "domain string, lang string, source string, capacity double")
    got = {tuple(r)[:3]: r["budget"] for r in budgets(df, ("domain", "lang", "source"), total, weights).collect()}
    want = plain_budgets(leaves, total, weights)
    for p, b in want.items():
        assert got.get(p, 0) == pytest.approx(b, abs=1.01), p
    assert sum(got.values()) <= total


def plain_mix(rows, share, epochs, seed="mix-1"):
    leaves, own = defaultdict(float), []
    for d, t, lang, source in rows:
        n = len((t or "").split())
        if n:
            leaf = (f"domain{zlib.crc32((source or '-').encode()) % 4}", lang or "-", source or "-")
            leaves[leaf] += n * epochs
            own.append((leaf, d, n, zlib.crc32(t.encode())))
    total = sum(n for _, _, n, _ in own)
    plan = plain_budgets(leaves, int(total * share), {})
    out = []
    for leaf, b in plan.items():
        budget, at = int(b + 1e-6), 0
        for e in range(1, epochs + 1):
            order = sorted((hashlib.md5(f"{seed}|{e}|{'null' if d is None else d}|{m}".encode()).hexdigest(), d, n) for x, d, n, m in own if x == leaf)
            for _, d, n in order:
                if at < budget:
                    out.append((d, e, at, min(n, budget - at)))
                at += n
    return sorted(out)


@pytest.mark.parametrize(("share", "epochs"), [(0.6, 2), (0.2, 1), (1.5, 2)])
def test_mix_equals_brute_force(spark, sf_dir, share, epochs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()] + [(9001, None, "en", "src0"), (9002, " ", "en", "src0"), (9003, "a b", None, None)]
    got = mix(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as epoch", "2 as tokens", "3 as budget"), share=share, epochs=epochs).collect()
    assert sorted((r["doc_id"], r["epoch"], r["start"], r["take"]) for r in got) == plain_mix(rows, share, epochs)


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (None, "a", "en", "s")], SCHEMA)
    assert mix(df, share=1.0).agg(F.sum("take")).first()[0] == 7
    assert mix(df, share=0.0).count() == 0
