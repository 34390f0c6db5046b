"""Very long texts: twice the text takes about twice the time, at half a megabyte and one. And very large groups of copies."""

import random
import time

import pytest

from sparkloom.llm import neardup
from sparkloom.llm.decontaminate import decontaminate
from sparkloom.llm.linededup import dedup_runs
from sparkloom.llm.media import media_digests, sniff
from sparkloom.llm.neardup import aligned, near_classes, sketch, word_hashes
from sparkloom.llm.pii import pii_report

SCHEMA = "doc_id long, text string"


def emails(n):
    return " ".join(f"a{i}@b{i}.example.com" for i in range(n))


def ibans(n):
    return " ".join(f"{'é' * (i % 3)} AT611904300234573201" for i in range(n))


def repeated_lines(n):
    return "\n".join(f"line {i // 2}" if i % 3 else f"own {i}" for i in range(n))


def hit(spark, text):
    rows = decontaminate(spark.createDataFrame([(1, text)], SCHEMA), spark.createDataFrame([(1, text)], "item_id long, text string")).collect()
    assert rows[0]["n_hit"] == rows[0]["n_words"] > 0


def runs(spark, text):
    rows = dedup_runs(spark.createDataFrame([(1, text), (2, text + "\nlast")], SCHEMA)).collect()
    assert sum(r["n_removed"] for r in rows) > 1000


CASES = {
    "pii emails": (emails, lambda spark, t: pii_report(spark.createDataFrame([(1, t)], SCHEMA)).collect(), 20_000),
    "pii ibans": (ibans, lambda spark, t: pii_report(spark.createDataFrame([(1, t)], SCHEMA)).collect(), 20_000),
    "benchmark hits": (lambda n: " ".join(f"w{i}" for i in range(n)), hit, 80_000),
    "line runs": (repeated_lines, runs, 50_000),
    "media signatures": (lambda n: "%PDF-1 PK\3\4 BM GIF89a RIFF\1\0\0\0WAVE" * n, lambda spark, t: media_digests(spark.createDataFrame([(1, t)], SCHEMA)).collect(), 15_000),
}


@pytest.mark.parametrize("name", CASES)
def test_time_is_in_proportion(spark, name):
    make, run, n = CASES[name]
    run(spark, make(2_000))
    took = []
    for size in (n, 2 * n):
        text = make(size)
        began = time.perf_counter()
        run(spark, text)
        took.append(time.perf_counter() - began)
    assert took[1] < 2.6 * took[0] + 2, took


def test_signatures_of_every_kind_take_linear_time():
    for unit in (b"%PDF-1 ", b"PK\3\4PK\5\6", b"\x89PNG\r\n\x1a\n\0\0\x10\0", b"\xff\xd8\xff\xe0\0\4", b"GIF89a\1\0\1\0\0\0\0!\xff\1"):
        took = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            sniff(unit * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 1, (unit, took)


def test_a_word_longer_than_a_piece():
    long = "x" * (3 * neardup.PIECE) + " a b c d e " + "y" * neardup.PIECE
    assert len(word_hashes(long)) == 7 and word_hashes(long)[1] == word_hashes("q a")[1] and sketch(long)
    assert (word_hashes("Ünï a1\tB-c")[[0, 1]] == word_hashes("ünï  A1")).all()


def test_recall_in_a_group_larger_than_a_cell(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(900):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8])):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [words[i], f"y{rng.randrange(10**6)}"]])
        texts.append(" ".join(words))
    hashes = [word_hashes(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [(i, j) for i in range(len(texts)) for j in range(i) if aligned(hashes[i], hashes[j]) > 0]
    for i, j in links:
        parent[find(i)] = find(j)
    got = {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    kept = sum(got[i] == got[j] for i, j in links) / len(links)
    true, found = len({find(i) for i in range(len(texts))}), len(set(got.values()))
    assert len(links) > 20_000 and kept > 0.999 and (len(texts) - found) / (len(texts) - true) > 0.99
    # Nothing is put together that no chain of links joins.
    assert all(find(i) == find(c) for i, c in got.items())
