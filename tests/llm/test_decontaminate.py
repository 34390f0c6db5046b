from reference_decontaminate import brute

from sparkloom.llm.decontaminate import decontaminate

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
ROWS = [
    (1, "A b, c"),
    (2, None),
    (3, ""),
    (None, "x a B c y a b c"),
    (3, "one two three four five six seven eight nine ten eleven twelve"),
    (3, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "w " * 40),
    (6, "Zéro Été à la plage " * 300),
]
BENCH = [(1, "a b C"), (2, "b c"), (3, "!!"), (4, None), (5, "zero one two three four five six seven eight nine ten"), (None, "y a"), (7, "w " * 12), (8, "plage zéro Été à la plage zéro Été à la plage")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force_on_edge_cases(spark):
    got = decontaminate(spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(BENCH, ITEMS))
    assert rows(got) == sorted(brute(ROWS, BENCH), key=str)


def test_equals_brute_force_on_the_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert any(r[-1] for r in want)
    assert rows(decontaminate(docs, bench)) == sorted(want, key=str)


def test_empty_tables_and_clashing_columns(spark):
    docs, bench = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(BENCH, ITEMS)
    assert not any(r["contaminated"] for r in decontaminate(docs, bench.limit(0)).collect())
    assert decontaminate(docs.limit(0), bench).count() == 0
    more = docs.selectExpr("*", "1 as row", "2 as w", "3 as n_hit", "4 as kept")
    assert rows(decontaminate(more, bench)) == rows(decontaminate(docs, bench))


def test_slices_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs, bench = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(BENCH, ITEMS)
    want = rows(decontaminate(docs, bench))
    monkeypatch.setattr("sparkloom.llm.decontaminate.KEPT_ROWS", 3)
    assert rows(decontaminate(docs, bench)) == want


def test_documents_shorter_than_a_window_cut_from_an_item(spark):
    item = "zero one two three four five six seven eight nine ten eleven".split()
    cuts = [item[s : s + n] for n in range(1, 13) for s in range(len(item) - n + 1)]
    docs = [(i, " ".join(w)) for i, w in enumerate(cuts)]
    for bench in ([(1, " ".join(item))], [(1, " ".join(item)), (2, "six seven"), (3, "two three four five six seven eight")]):
        got = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, ITEMS))
        assert rows(got) == sorted(brute(docs, bench), key=str)
