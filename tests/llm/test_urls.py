import re

import numpy as np

from sparkloom.llm import urls
from sparkloom.llm.urls import fit, judge

SCHEMA = "page_id long, url string"
URLS = [
    None, "", "no scheme", "http://Net/x", "https://a.example.NET/en/1?x#y", "https://a.example.net/de/1", "http://badnet/a", "ftp://x.org/fr/2", "http://x.org/fr", "http://example.com/de/",
    "http://example.com?x=://y.net/", "http://ünï.net#/en/", "a://b://c.net/", "http://example.com/de/\nx", "http://EXAMPLE.org/fr/a?b=1&c=2", "http://" + "x" * 50_000 + ".com/" + "9" * 50_000,
]
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def check(rows, urls_by_id):
    for r in rows:
        host, path, rule = plain(urls_by_id[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls_by_id[r["page_id"]]
        assert r["verdict"] == RULES[rule] if rule else r["verdict"] in ("allow", "block")


def test_rules_equal_the_plain_statement(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), SCHEMA)
    rows = judge(df.selectExpr("*", "1 as host", "2 as fits")).collect()
    assert len(rows) == len(URLS)
    check(rows, dict(enumerate(URLS)))


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    check(judge(pages).collect(), {r[0]: r[1] for r in pages.select("page_id", "url").collect()})


def test_empty_and_one_class(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), SCHEMA)
    assert judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in judge(df, rules=()).collect()} == {"allow"}
    assert {r["verdict"] for r in judge(df, rules=(("net/", "block"),)).collect()} == {"block"}


def test_trees_learn_labelled_urls(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(2000):
        bad = i % 2
        tail = "".join(rng.choice(list("0123456789" if bad else "abcdefghij"), 12))
        rows.append((f"http://h{i % 50}.example.com/{tail}{'?a=1&b=2' if bad and i % 3 else ''}", bool(bad)))
    train, test = rows[:1500], rows[1500:]
    host = lambda u: u.split("/")[2]
    path = lambda u: u[u.index("/", 8) :].split("?")[0]
    model = fit([u for u, _ in train], [host(u) for u, _ in train], [path(u) for u, _ in train], [b for _, b in train])
    x = model.features([u for u, _ in test], [host(u) for u, _ in test], [path(u) for u, _ in test])
    assert ((model.margin(x) > 0) == [b for _, b in test]).mean() > 0.98
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://new.example.com/982374982374"), (2, "http://new.example.com/abcabcabcabc")], SCHEMA)
    assert {r["page_id"]: r["verdict"] for r in judge(pages, rules=(), labelled=labelled).collect()} == {1: "block", 2: "allow"}
    assert urls.MAX_ROWS >= 1000


LABELLED = "url string, blocked boolean"


def test_suffix_statistics_count_all_labelled_rows(spark):
    rows = [(f"http://s{i % 300:03}.com/{i:05}", bool(i % 300 % 2)) for i in range(6000)]
    pages = spark.createDataFrame([(i, f"http://s{i:03}.com/99999") for i in range(300)], SCHEMA)
    got = judge(pages, rules=(), labelled=spark.createDataFrame(rows, LABELLED), max_rows=200).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {i: "block" if i % 2 else "allow" for i in range(300)}


def test_sample_holds_a_hot_url_and_is_not_cut_by_name(spark):
    hot = "http://a.com/hot"
    rows = [(hot, i % 4 == 0) for i in range(2000)] + [(f"http://b{i:04}.com/", False) for i in range(4000)]
    df = spark.createDataFrame(rows, LABELLED).selectExpr("*", "'h' as host", "'/' as path")
    got = {r["url"]: r for r in urls.sample(df, len(rows), 300).collect()}
    assert 100 < len(got) <= 300 and got[hot]["n_rows"] == 2000 and got[hot]["n_blocked"] == 500
    assert 0.25 < got[hot]["weight"] / sum(r["weight"] for r in got.values()) < 0.42
    places = [int(u[8:12]) for u in got if u != hot]
    assert min(places) < 400 and max(places) > 3600 and 1600 < sum(places) / len(places) < 2400


def test_small_tables_learn_from_every_row(spark):
    rows = [(f"http://h{i % 7}.{'org' if i % 3 else 'net'}/{'x' * (i % 11)}?a={i % 5}", i % 3 == 0 or i % 11 > 8) for i in range(400)]
    rows += [rows[5]] * 40 + [(rows[5][0], not rows[5][1])] * 9
    hosts, paths = [plain(u)[0] for u, _ in rows], [plain(u)[1] for u, _ in rows]
    model = fit([u for u, _ in rows], hosts, paths, [b for _, b in rows])
    score = 1 / (1 + np.exp(-model.margin(model.features([u for u, _ in rows], hosts, paths))))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], SCHEMA)
    got = judge(pages, rules=(), labelled=spark.createDataFrame(rows, LABELLED)).collect()
    assert len(got) == len(rows) and max(abs(r["block_score"] - score[r["page_id"]]) for r in got) < 2e-6
