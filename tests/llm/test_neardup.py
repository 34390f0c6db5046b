import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from sparkloom.llm import neardup
from sparkloom.llm.components import components
from sparkloom.llm.neardup import aligned, labelled, near_classes, sketch, word_hashes

SCHEMA = "doc_id long, text string"


def plain_similarity(a, b):
    """Longest common sequence of labelled shingles, by the textbook table."""

    def marks(text):
        w = neardup.WORD.findall(text.lower())
        seen, out = Counter(), []
        for i in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[i : i + 5])
            seen[s] += 1
            out.append((s, seen[s]))
        return out

    x, y = marks(a), marks(b)
    if not x or not y:
        return 0.0
    common = len(set(x) & set(y))
    if common / (len(x) + len(y) - common) < 0.79:  # no order can make it more
        return 0.0
    row = [0] * (len(y) + 1)
    for p in x:
        last = row
        row = [0]
        for j, q in enumerate(y):
            row.append(last[j] + 1 if p == q else max(last[j + 1], row[j]))
    return row[-1] / (len(x) + len(y) - row[-1])


def plain_classes(docs):
    texts = sorted({t for _, t in docs if t is not None})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if find(a) != find(b) and plain_similarity(a, b) >= 0.8:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for d, t in docs:
        if t is not None:
            least[find(t)].append(d)
    return sorted((d, d if t is None else min(x for x in least[find(t)] if x is not None)) for d, t in docs)


def corpus(seed=3, groups=12, copies=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 30, 90, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[i], "new"]])
            out.append(" ".join(words))
    return out


def test_alignment_equals_the_table():
    texts = corpus() + ["a b c d e a b c d e a b c d e", "a b c d e a b c d e x", "", "one"]
    texts += [" ".join(t.split()[60:] + t.split()[:60]) for t in texts if len(t.split()) > 150]
    for a in texts:
        for b in texts[::5]:
            want = plain_similarity(a, b)
            assert aligned(word_hashes(a), word_hashes(b)) == pytest.approx(want if want >= 0.8 - 1e-9 else 0.0)


def test_sketches_find_similar_pairs():
    texts = corpus(seed=9, groups=40)
    sketches = [set(sketch(t)) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] != texts[j] and plain_similarity(texts[i], texts[j]) >= 0.8]
    assert len(pairs) > 100
    assert sum(bool(sketches[i] & sketches[j]) for i, j in pairs) / len(pairs) > 0.995
    assert sketch("") == [] and len(labelled(np.zeros(0, np.uint32))[0]) == 0


def copies_of_one_text(n=150):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            j = rng.randrange(len(words))
            words[j : j + 1] = rng.choice([[], [f"x{rng.randrange(40)}"], [words[j], f"y{rng.randrange(40)}"]])
        out.append(" ".join(words[rng.choice([0, 0, 0, 15]) : rng.choice([200, 200, 95])]))
    return out


def test_classes_equal_brute_force(spark):
    docs = list(enumerate(corpus() * 2 + copies_of_one_text() + ["", None, "", None, "two words", "Two, WORDS!", "... !!"], 100))
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as tid", "2 as class_id", "3 as bucket")
    got = near_classes(df).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == plain_classes(docs)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def bucket_classes(texts):
    """Least place of each text's class, where all similar texts that share a component are linked."""
    parent = list(range(len(texts)))
    hashes, sketches = [word_hashes(t) for t in texts], [set(sketch(t)) for t in texts]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and sketches[i] & sketches[j] and aligned(hashes[i], hashes[j]) > 0:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def far_copies(n, seed):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8])):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [words[i], f"y{rng.randrange(10**6)}"]])
        out.append(" ".join(words))
    return out


def test_no_link_is_lost_in_buckets_larger_than_a_cell(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 4)
    monkeypatch.setattr(neardup, "BLOCK", 7, raising=False)
    texts = far_copies(200, 5) + [" ".join(t.split()[:120]) for t in far_copies(60, 6)] + corpus(seed=4)
    texts = sorted(set(texts), key=texts.index)
    got = near_classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert [c for _, c in sorted((r["doc_id"], r["class_id"]) for r in got)] == bucket_classes(texts)


def test_no_link_is_lost_in_a_group_larger_than_a_cell(spark):
    texts = far_copies(900, 2)
    got = near_classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert [c for _, c in sorted((r["doc_id"], r["class_id"]) for r in got)] == bucket_classes(texts)


def test_empty_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "x"), (None, None)], SCHEMA)
    assert sorted(((r["doc_id"], r["class_id"]) for r in near_classes(df).collect()), key=str) == [(1, 1), (1, 1), (2, 2), (None, 1), (None, None)]
    assert near_classes(df.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5), (None, 7), (200, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def test_few_links_make_few_files_in_the_checkpoint_folder(spark):
    def made(run):
        files = lambda: len(list(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*")))
        before = files()
        return run().collect(), files() - before

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
        got, n = made(lambda: components(links))
        assert {r["node"]: r["root"] for r in got} == {i: 0 for i in range(31)} and n < 20, n
        texts = far_copies(20, 5)
        got, n = made(lambda: near_classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)))
        assert {r["class_id"] for r in got} == set(bucket_classes(texts)) and n < 250, n
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_short_similar_texts_always_share_a_component():
    rng, met = random.Random(11), Counter()
    # Shingles of the two texts: the second lacks the first shingle of the first, or each has one of its own.
    for n, m, times in ((5, 4, 20000), (6, 5, 500), (8, 7, 500), (9, 8, 500), (9, 9, 4000), (10, 9, 500), (13, 12, 500), (13, 13, 500)):
        for _ in range(times):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
            other = words[1:] if m < n else [*words[:-1], "other"]
            assert len(other) == m + 4
            met[n, m] += not set(sketch(" ".join(words))) & set(sketch(" ".join(other)))
    assert not +met, met


def test_short_texts_with_edits_against_the_table():
    rng = random.Random(12)
    pairs = 0
    for _ in range(6000):
        words = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 17))]
        other = list(words)
        for _ in range(rng.choice([1, 1, 2])):
            i = rng.choice([0, 0, len(other) - 1, len(other) - 1, rng.randrange(len(other))]) if other else 0
            other[i : i + 1] = rng.choice([[], ["q"], [*other[i : i + 1], "r"]])
        a, b = " ".join(words), " ".join(other)
        if a != b and plain_similarity(a, b) >= 0.8 - 1e-9:
            pairs += 1
            assert set(sketch(a)) & set(sketch(b)), (a, b)
    assert pairs > 300
