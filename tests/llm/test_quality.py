import numpy as np
import pytest

from sparkloom.llm.quality import features, fit, score_quality

DOCS, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, quality int"


def test_labelled_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.filter("doc_id % 3 <> 0")
    rows = score_quality(docs, train).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) / len(rows) > 0.95
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["kept"] for r in good) / len(good) > 0.97


def test_sparse_sites_shrink_and_sums_follow_the_formula(spark):
    rows = [(i, "plain words stand here in a row", "en", "big") for i in range(60)] + [(i, "### $$$ %%% ### $$$", "en", "bad") for i in range(60, 120)] + [(200, "### $$$ %%% ### $$$", "en", "one")]
    labels = [(i, int(i < 60)) for i in range(120)]
    got = {r["doc_id"]: r for r in score_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[0]["kept"] and not got[60]["kept"]
    assert got[60]["host_share"] < got[200]["host_share"] < got[0]["host_share"]


def test_edge_cases(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "en", "s"), (2, "x" * 100_000, "en", "s")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as host", "2 as p", "3 as margin")
    got = score_quality(df, spark.createDataFrame([(2, 1), (2, 1), (None, 0)], LABELS)).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    empty = spark.createDataFrame([], LABELS)
    assert {r["doc_score"] for r in score_quality(df, empty).collect()} == {0.5}
    assert score_quality(df.limit(0), empty).count() == 0


def test_fit_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 14))
    y = (x[:, 0] + 0.1 * rng.normal(size=500) > 0).astype(float)
    beta = fit(x, y)
    assert beta[1] > 5 and fit(x, np.ones(500)).tolist() == [0.0] * 29
    assert features(None).shape == features("a b\nc").shape and features("é!").max() == pytest.approx(features("é!").max())
