"""Repeated runs of lines against a brute force that knows no chunks."""

import random

from sparkloom.llm import linededup
from sparkloom.llm.linededup import dedup_lines, dedup_runs

SCHEMA = "doc_id long, text string"


def plain(docs):
    """Every pair of adjacent lines, looked up at every earlier place that shares no line with it."""
    places = sorted((d is None, d or 0, row) for row, (d, _) in enumerate(docs))
    lines = [[] if t is None else t.split("\n") for _, t in docs]
    seen, lost = {}, [set() for _ in docs]
    for *_, row in places:
        for at in range(len(lines[row]) - 1):
            pair = tuple(lines[row][at : at + 2])
            if any(other != row or at - there >= 2 for other, there in seen.setdefault(pair, [])):
                lost[row] |= {at, at + 1}
            seen[pair].append((row, at))
    out = []
    for row, (d, text) in enumerate(docs):
        ranges = []
        for i in sorted(lost[row]):
            if ranges and sum(ranges[-1]) == i:
                ranges[-1][1] += 1
            else:
                ranges.append([i, 1])
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines[row]) if i not in lost[row])
        out.append((d, kept, len(lines[row]), len(lost[row]), ",".join(f"{a}+{n}" for a, n in ranges)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(8)) + str(rng.random())
    passages = [[line() for _ in range(n)] for n in (1, 2, 2, 3, 4, 9, 40)]
    docs = []
    for i in range(90):
        own = [line() for _ in range(rng.randint(1, 12))]
        for _ in range(i % 3):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)
        docs.append((i, "\n".join(own)))
    docs += [(None, docs[3][1]), (200, None), (201, ""), (202, "\n\n\n"), (203, "\n\n\n"), (204, docs[4][1]), (204, docs[5][1]), (205, "x\n" * 300)]
    docs += [(206, "\n".join(rng.choice("abc") for _ in range(60))), (207, "é\n𝄞\nx\nx"), (208, "q\r\ne f\né\n𝄞"), (209, "a\nb"), (209, "a\nb")]
    rng.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).coalesce(1)


def test_runs_equal_brute_force(spark):
    docs = corpus()
    got = dedup_runs(frame(spark, docs).selectExpr("*", "1 as row", "2 as a", "3 as at", "4 as h")).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs)


def test_query_finds_a_two_line_run_wherever_it_stands(spark, tmp_path):
    from sparkloom.llm.queries import op2_linededup

    docs = [(i, "\n".join([*(f"own {i} {k}" for k in range(i)), "shared one", "shared two", f"end {i}"])) for i in range(30)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["removed"] for r in op2_linededup(spark, str(tmp_path)).collect()} == {i: f"{i}+2" if i else "" for i in range(30)}


def test_runs_remove_all_that_chunks_remove_and_keep_each_line_once(spark):
    docs = [(i, t) for i, (_, t) in enumerate(corpus())]

    def lost(df):
        return {(r["doc_id"], i) for r in df.collect() for a, n in (x.split("+") for x in r["removed"].split(",") if x) for i in range(int(a), int(a) + int(n))}

    assert lost(dedup_lines(frame(spark, docs))) < lost(dedup_runs(frame(spark, docs)))
    kept = {x for r in dedup_runs(frame(spark, docs)).collect() if r["text"] for x in r["text"].split("\n")}
    assert kept >= {x for _, t in docs if t for x in t.split("\n") if x}


def test_bytes_of_lines_are_compared_when_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(linededup, "_line_hash", lambda line: linededup.F.lit(7).cast("long"))
    docs = corpus()
    assert sorted((tuple(r) for r in dedup_runs(frame(spark, docs)).collect()), key=str) == plain(docs)


def test_runs_of_an_empty_table(spark):
    assert dedup_runs(frame(spark, []).limit(0)).count() == 0
