"""Path classes, rule packs and structure on literal files."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import fixed, packs
from sparkloom.operators import graph, state, tree
from sparkloom.plans.samples import sample


def classes(spark, paths, **columns):
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", *[c(F.col("path")).alias(n) for n, c in columns.items()])
    return {r["path"]: tuple(r[n] for n in columns) for r in df.collect()}


def test_languages_and_manifests(spark):
    got = classes(spark, ["a/x.PY", "Dockerfile", "DOCKERFILE", "q.R", ".env", "x/.gitignore", "noend", "a.b.tsx", "go.mod", "x.gemspec", "Package.swift", "..py", "Z.unknown"], lang=tree.language, eco=tree.ecosystem)
    assert got == {
        "a/x.PY": ("Python", None), "Dockerfile": ("Dockerfile", None), "DOCKERFILE": ("Dockerfile", None), "q.R": ("R", None), ".env": ("Dotenv", None), "x/.gitignore": (None, None), "noend": (None, None),
        "a.b.tsx": ("TypeScript", None), "go.mod": ("Go", "go"), "x.gemspec": ("Ruby", "rubygems"), "Package.swift": ("Swift", "swift"), "..py": (None, None), "Z.unknown": (None, None),
    }


def test_path_classes(spark):
    got = classes(
        spark, ["tests/a.py", "src/a_test.go", "src/a.py", ".github/workflows/ci.yml", "deploy/main.tf", "Yarn.lock", "LICENSE.md", "sub/COPYING", "id_rsa", "a/node_modules/b.js", "node_modules", "README.md", None],
        test=tree.is_test, ci=tree.is_continuous, iac=tree.is_infrastructure, lock=tree.is_lockfile, lic=tree.is_license, only=tree.is_secret_only, skip=tree.is_skipped, prose=tree.is_prose,
    )
    true = {p: {n for n, v in zip(("test", "ci", "iac", "lock", "lic", "only", "skip", "prose"), row, strict=True) if v} for p, row in got.items()}
    assert true == {
        "tests/a.py": {"test"}, "src/a_test.go": {"test"}, "src/a.py": set(), ".github/workflows/ci.yml": {"ci"}, "deploy/main.tf": {"iac"}, "Yarn.lock": {"lock"}, "LICENSE.md": {"lic", "prose"},
        "sub/COPYING": {"lic"}, "id_rsa": {"only"}, "a/node_modules/b.js": {"skip"}, "node_modules": set(), "README.md": {"prose"}, None: set(),
    }


CORE = [*fixed.SECRETS, *fixed.RISKS]


@pytest.mark.parametrize(("name", "pattern"), [(r[0], r[1]) for r in CORE], ids=lambda x: x[:20])
def test_each_core_rule_fires_on_a_literal(name, pattern):
    literal = sample(pattern)
    assert re.search(pattern, literal), (name, literal)


def test_low_level_send_needs_a_question_mark():
    pattern = dict((r[0], r[1]) for r in fixed.RISKS)["unchecked_send"]
    assert re.search(pattern, 'a.call{value: 1}?("")') and not re.search(pattern, 'a.call{value: 1}("")')


def test_every_rule_of_every_pack_fires_once_sampled(spark):
    ends = {v: k for k, v in reversed(packs.LANGUAGE_BY_END.items())}
    rows, want = [], set()
    for lang in [None, *packs.BY_LANGUAGE, "TypeScript", "C++"]:
        for rule in tree.pack_of(lang) if lang else [*tree.SECRETS, *tree.COMMON, *tree.SUPPLY]:
            path = f"s/{len(rows)}" + (ends[lang] if lang in ends else ".groovy" if lang is None else ".none")
            rows.append((path, sample(rule.pattern)))
            if rule.id != "secret:xml_credential":  # what it matches always looks like a placeholder
                want.add((path, rule.id))
    found = {(r["path"], r["rule"]) for r in tree.findings(spark.createDataFrame(rows, "path string, body string")).collect()}
    missing = sorted(want - found)
    assert not missing, (len(missing), [(m, dict(rows)[m[0]]) for m in missing[:5]])


def test_needles_are_in_every_match():
    for rule in [*tree.SECRETS, *tree.COMMON, *tree.SUPPLY, *(r for lang in packs.BY_LANGUAGE for r in tree.pack_of(lang))]:
        some, match = tree.needles(rule.pattern), re.search(rule.pattern, sample(rule.pattern))
        assert match and (not some or any(n in tree.fold(match[0]) for n in some)), rule
    assert tree.needles(r"(?i)(?:abc|de)\s*xyzw?") == ("xyz",) and tree.needles(r"\d+[ab]") == ()


def test_prose_gets_secrets_only_and_placeholders_nothing(spark):
    key = "AKIA" + "QWERTYUIOPASDFGH"
    rows = [("a.md", f"eval(x) {key}"), ("a.py", "eval(x)"), ("b.py", "AKIA" + "IOSFODNN7EXAMPLE"), ("c.py", None), ("d.py", "\n\neval(x)"), ("e.ts", "new Function('x')")]
    found = tree.findings(spark.createDataFrame(rows, "path string, body string")).collect()
    assert {(r["path"], r["rule"], r["line"]) for r in found} == {("a.md", "secret:aws_access_key", 1), ("a.py", "risk:eval_use", 1), ("d.py", "risk:eval_use", 3), ("e.ts", "risk:new_function", 1)}
    assert not any(key in r["snippet"] + r["detail"] for r in found)


def test_python_functions(spark):
    body = "import x\n\ndef a(q):\n    pass\n\n\n    async def b():\n        pass\nx = 1\ndef c():\n    y\n\n    z\nend\n"
    got = tree.python_functions(spark.createDataFrame([("a.py", body), ("b.py", "x"), ("c.py", "def only():\n  1")], "path string, body string")).collect()
    assert sorted((r["path"], r["name"], r["line"], r["length"]) for r in got) == [("a.py", "a", 2, 3), ("a.py", "b", 5, 5), ("a.py", "c", 10, 4), ("c.py", "only", 1, 2)]


def test_inventory_notes(spark):
    rows = [("t", "a.py", "x # TODO\n\ny"), ("t", "b/.env", "K=1"), ("u", "LICENSE", "MIT License"), ("u", "tests/a.js", "x"), ("u", "yarn.lock", ""), ("u", ".travis.yml", "")]
    got = {r["tree"]: r for r in tree.inventory(spark.createDataFrame(rows, "tree string, path string, body string"), "tree").collect()}
    assert (got["t"]["files"], got["t"]["loc"], got["t"]["todos"]) == (2, 3, 1)
    assert got["t"]["notes"] == [fixed.NOTES["python"], fixed.NOTES["license"], fixed.NOTES["tests"], fixed.NOTES["continuous"], "b/.env" + fixed.NOTES["dotenv"]]
    assert got["u"]["notes"] == [] and got["u"]["lockfiles"] == ["yarn.lock"] and got["u"]["continuous"] == [".travis.yml"]


def test_budget_passes_over_what_does_not_fit(spark):
    rows = [("t", f"{i}", n) for i, n in enumerate([40, 70, 50, 20, None, 10])]
    got = tree.within_budget(spark.createDataFrame(rows, "tree string, path string, size long"), "tree", "path", "size", most_files=3, each=60, total=100).collect()
    assert {r["path"] for r in got if r["admitted"]} == {"0", "2", "5"}


def test_cache_is_fresh_from_the_store_only(spark):
    rows = [("k", i, float(t)) for i, t in enumerate([0, 50, 90, 100, 150])] + [(None, 9, 1.0)]
    got = {r["i"]: r["outcome"] for r in state.cache_outcomes(spark.createDataFrame(rows, "k string, i int, t double"), "k", "t", "i", 100.0).collect()}
    assert got == {0: "miss", 1: "hit", 2: "hit", 3: "revalidated", 4: "revalidated", 9: "miss"}


def test_daily_budget_refuses_repeats_and_a_clock_that_runs_back(spark):
    rows = [("k", i, float(t), r) for i, (t, r) in enumerate([(86400 * 5, "a"), (86400 * 5 + 40, "a"), (86400 * 5 + 40, "b"), (86400 * 5 + 39, "c"), (86400 * 5 + 60, "c"), (86400 * 6, "a"), (86400 * 5 + 500, "z")])]
    df = spark.createDataFrame(rows, "k string, i int, t double, r string")
    got = {r["day"]: r["accepted"] for r in state.daily_budget(df, ["k"], "t", ["i"], 20, 30, "r").collect()}
    assert got == {5: 2, 6: 1}


def test_external_hosts_by_arrival(spark):
    rows = [(1, "https://a/", "https://x/"), (2, "https://a/", "https://a/own"), (3, "https://a/", "https://y/"), (4, "https://a/", "https://z/"), (5, "https://a/", "https://x/2")]
    got = graph.external_hosts(spark.createDataFrame(rows, "at int, src string, dst string"), ["at"], 2).collect()
    assert {(r["host"], r["n"]) for r in got} == {("x", 2), ("y", 1)}


def test_hints_are_in_every_text_with_a_match():
    from sparkloom.functions.needles import hints

    for rule in [*tree.SECRETS, *tree.COMMON, *tree.SUPPLY, *(r for lang in packs.BY_LANGUAGE for r in tree.pack_of(lang))]:
        some = hints(rule.pattern)
        assert not some or any(n in tree.fold(sample(rule.pattern)) for n in some), rule
    assert hints(r"\b[0-9]{4}\b(?=[^\n]{0,9}Pin)") == ("pin",) and hints(r"x(?!yes)\d") == ("x",) and hints(r"\d(?!yes)") == ()
