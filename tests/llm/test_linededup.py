import random
from collections import defaultdict

from sparkloom.llm import linededup
from sparkloom.llm.linededup import chunk_ends, chunks, dedup_lines

SCHEMA = "doc_id long, text string"


def plain(docs):
    places = defaultdict(list)
    for row, (d, text) in enumerate(docs):
        for at, n, lines in chunks(text):
            if n >= 2:
                places[lines.removesuffix("\n")].append((d is None, d or 0, row, at, n))
    gone = defaultdict(list)
    for found in places.values():
        for _, _, row, at, n in sorted(found)[1:]:
            gone[row].append((at, n))
    out = []
    for row, (d, text) in enumerate(docs):
        lines = [] if text is None else text.split("\n")
        lost = {i for at, n in gone[row] for i in range(at, at + n)}
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in lost)
        out.append((d, kept, len(lines), len(lost), ",".join(f"{a}+{n}" for a, n in sorted(gone[row]))))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(8)) + str(rng.random())
    passages = [[line() for _ in range(rng.randint(4, 40))] for _ in range(6)]
    docs = []
    for i in range(80):
        own = [line() for _ in range(rng.randint(1, 30))]
        if i % 3:
            own[rng.randint(0, len(own)) : 0] = rng.choice(passages)
        docs.append((i, "\n".join(own)))
    return docs + [(None, docs[3][1]), (200, None), (201, ""), (202, "\n\n\n"), (203, "\n\n\n"), (204, docs[4][1]), (205, "x\n" * 3000)]


def test_boundaries_resist_shifts():
    lines = [f"line {i}" for i in range(400)]
    ends = chunk_ends(lines)
    assert ends[-1] == 400 and all(0 < b - a <= linededup.MOST for a, b in zip([0, *ends], ends))
    shifted = chunk_ends(["new", *lines])
    assert len({e + 1 for e in ends} & set(shifted)) > 0.9 * len(ends)
    assert "".join(x for _, _, x in chunks("\n".join(lines))) == "\n".join(lines)


def test_equals_brute_force(spark):
    docs = corpus()
    got = dedup_lines(spark.createDataFrame(docs, SCHEMA).coalesce(1).selectExpr("*", "1 as row", "2 as key", "3 as words")).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs)


def test_bytes_are_compared_when_hashes_clash(spark, monkeypatch):
    one, two = [t for t in (f"a{i}\nb{i}" for i in range(60)) if chunk_ends(t.split("\n")) == [2]][:2]
    docs = [(1, one), (2, two), (3, one)]
    df = spark.createDataFrame(docs, SCHEMA).coalesce(1)
    clashing = lambda rows, with_text: real(rows, with_text).withColumn("key", linededup.F.lit(b"same"))
    real = linededup._chunk_rows
    monkeypatch.setattr(linededup, "_chunk_rows", clashing)
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(df).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
