from pyspark.sql import functions as F
from reference_decontaminate import brute
from test_mixing import plain_mix
from test_neardup import bucket_classes, far_copies, plain_classes

import corpus_pipeline as pipeline
from sparkloom.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    stage = dict(pipeline.STAGES)

    before = rows(docs)
    docs = stage["language"](spark, docs, sf_dir).cache()
    after = rows(docs)
    assert set(after) == {d for d, r in before.items() if any(c.isalpha() for c in r["text"] or "")}

    classes = dict(plain_classes([(d, r["text"]) for d, r in after.items()]))
    docs = stage["near_dedup"](spark, docs, sf_dir).cache()
    assert set(rows(docs)) == {d for d in after if classes[d] == d}

    hit = {r[0] for r in brute([(d, r["text"]) for d, r in rows(docs).items()], bench) if r[-1]}
    want = set(rows(docs)) - hit
    docs = stage["decontamination"](spark, docs, sf_dir).cache()
    assert hit and set(rows(docs)) == want

    held = [(d, r["text"], r["lang"], r["source"]) for d, r in rows(docs).items()]
    docs = stage["mixing"](spark, docs, sf_dir).cache()
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    total = sum(len(t.split()) for _, t, _, _ in held)
    got = sum(len(r["text"].split()) for r in rows(docs).values())
    assert 0 < len(rows(docs)) < len(held) and got >= 0.8 * total - 1000
    assert len(rows(docs)) == len(plain_mix(held, 0.8, 1)) or abs(len(rows(docs)) - len(plain_mix(held, 0.8, 1))) <= 0.05 * len(held)

    last = stage["sharding"](spark, docs, sf_dir)
    assert set(rows(last)) == set(rows(docs))


def test_repeated_rows_null_ids_and_extra_columns(spark, sf_dir):
    text = "some words that nobody would take for a benchmark item at all"
    data = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (None, "lone text", None, None, None), (None, "lone text", None, None, None), (5, None, "en", "s", 0), (5, "... 12", "en", "s", 6)]
    docs = spark.createDataFrame(data, SCHEMA).withColumn("row_key", F.lit(1)).withColumn("lang_pred", F.lit(2))
    out = pipeline.language(spark, docs, sf_dir)
    assert out.count() == 6 and out.columns == docs.columns and out.filter("lang is null").count() == 0
    out = pipeline.near_dedup(spark, out, sf_dir)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(1, text), (None, "lone text")]
    out = pipeline.without_benchmark(spark, out, sf_dir)
    assert out.count() == 2
    assert pipeline.mixed(spark, out.limit(0), sf_dir).count() == 0


def test_near_copies_of_a_large_group_are_all_dropped(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 4)
    texts = far_copies(200, 5) + [" ".join(t.split()[:120]) for t in far_copies(60, 6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert set(rows(pipeline.near_dedup(spark, docs, sf_dir))) == set(bucket_classes(texts))


def test_run_on_empty_documents(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
