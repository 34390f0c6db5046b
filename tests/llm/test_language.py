import zlib

import numpy as np

from sparkloom.llm import language
from sparkloom.llm.language import bundle, identify

SCHEMA = "doc_id long, text string, lang string"


def test_bundle_is_the_sum_of_bound_letter_vectors(monkeypatch):
    text = "Ab, ä!"
    symbols = [32, ord("a"), ord("b"), 32, ord("ä"), 32]
    want = np.zeros(64)
    for x, y, z in zip(symbols, symbols[1:], symbols[2:]):
        v = [language._letter_vector(p, 64).astype(int) for p in (x, y, z)]
        want += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    assert (bundle([text, "", None, "12 "], 64)[0] == want).all()
    assert not bundle([text, "", None, "12 "], 64)[1:].any()
    monkeypatch.setattr(language, "PIECE", 2)
    monkeypatch.setattr(language, "BLOCK", 2)
    assert (bundle([text, "x"], 64)[0] == want).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_cases(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("", None), ("123 !", "de"), ("the dog", None), ("x", "en"), ("the " * 9000, None)] * 6)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as lang_pred", "3 as l")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    assert got[5]["lang_pred"] == "en"
    empty = spark.createDataFrame(rows, SCHEMA).limit(0)
    assert identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None), (None, "abc", None)], SCHEMA)
    assert {r["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}
