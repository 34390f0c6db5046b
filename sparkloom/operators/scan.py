"""Rules against texts: flags in the JVM, findings with positions in one Arrow function.

Flags use literal patterns, which Spark compiles once; findings need every match's place and a masked snippet, and
go through Python's regular expressions, one batch at a time. Rule packs are data: pass your own list to use more.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sparkloom.functions import fixed, needles, text
from sparkloom.session import small_batches

FINDING = "path string, rule string, severity string, line int, detail string, snippet string, snippet_sha256 string, receipt string"


def java(pattern: str) -> str:
    """A pattern with the line ends of Unix and words of all scripts."""
    return f"(?dU){pattern}"


def flags(df: DataFrame, column: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """A row (rule, score, severity) for each rule that matches, beside the other columns.

    A rule's expression is tried only where the text has a string that every match of it has.
    """
    t, low = F.col(column), F.col("text_folded")
    hits = F.array_compact(F.array(*[F.when(needles.likely(low, pattern) & t.rlike(pattern), F.struct(F.lit(rule).alias("rule"), F.lit(score).alias("score"))) for rule, pattern, score in rules]))
    return df.withColumn("text_folded", needles.folded(t)).withColumn("hit", F.explode(hits)).select(*[c for c in df.columns if c != column], F.col("hit.rule").alias("rule"), F.col("hit.score").alias("score"), text.severity(F.col("hit.score")).alias("severity"))


def _masked(token: str) -> str:
    token = token.strip()
    return f"{token[:3]}***" if len(token) <= 12 else f"{token[:6]}…{token[-4:]} ({len(token)} chars)"


#: Findings that a Python worker holds before they leave it.
MOST_HELD = 1_000


def searched(rows: DataFrame, keep: list[str], search: Callable[..., Iterator[tuple]]) -> DataFrame:
    """``keep`` and the findings of each row, which ``search`` gives for the values of its other columns in order.

    Texts are taken out of a batch one at a time, and findings leave in pieces, so a worker holds little beside the batch itself.
    """
    small_batches(rows.sparkSession)
    schema = StructType([*(rows.schema[k] for k in keep), *StructType.fromDDL(FINDING)])
    others = [c for c in rows.columns if c not in keep]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*out, strict=True), schema.fields, strict=True)], schema.fieldNames())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            kept, read = [batch.column(k) for k in keep], [batch.column(c) for c in others]
            for i in range(batch.num_rows):
                for found in search(*(c[i].as_py() for c in read)):
                    out.append((*(c[i].as_py() for c in kept), *found))
                    if len(out) >= MOST_HELD:
                        yield packed(out)
                        out = []
        if out:
            yield packed(out)

    return rows.mapInArrow(walk, schema)


class _Packs:
    """Compiled rules, and what a text must have for each of them to be tried."""

    def __init__(self, rules: tuple[tuple[str, str, int], ...], examples: bool) -> None:
        self.packs = [(name, re.compile(p), score, needles.needles(p), needles.solid(p)) for name, p, score in rules]
        self.secrets = [re.compile(p) for _, p, _ in fixed.SECRETS]
        self.example = None if examples else re.compile(fixed.EXAMPLE)

    def rows(self, path: str | None, body: str | None) -> Iterator[tuple]:
        if not isinstance(body, str):
            return
        shown, low, most = None, needles.fold(body), needles.longest(body)
        for name, pattern, score, some, least in self.packs:
            if least > most or (some and not any(n in low for n in some)):
                continue
            for m in pattern.finditer(body):
                if self.example and self.example.search(m[0]):
                    continue
                shown = body.splitlines() if shown is None else shown
                line = body.count("\n", 0, m.start()) + 1
                if line > len(shown):
                    continue
                snippet = shown[line - 1]
                for secret in self.secrets:
                    snippet = secret.sub(lambda s: _masked(s[0]), snippet)
                snippet = snippet.strip()[:200]
                digest = hashlib.sha256(snippet.encode("utf-8", "surrogatepass")).hexdigest()
                sev = next(s for at_least, s in ((90, "critical"), (70, "high"), (30, "medium"), (-1, "low")) if score >= at_least)
                mark = hashlib.sha256(f"{name}|{path}|{line}|{digest}".encode()).hexdigest()[:16]
                yield path, name, sev, line, _masked(m[0]), snippet, digest, f"sha256:{mark}"


@functools.cache
def _packs(rules: tuple[tuple[str, str, int], ...], examples: bool) -> _Packs:
    """One for each worker and set of rules."""
    return _Packs(rules, examples)


def findings(df: DataFrame, path: str, column: str, rules: list[tuple[str, str, int]] | None = None, examples: bool = False) -> DataFrame:
    """Every match of every rule: line, masked snippet, digest and receipt. Placeholders are dropped unless ``examples``.

    Texts that have none of the strings that a match must have never leave the JVM, if every rule has such strings.
    """
    rules = rules or [*fixed.SECRETS, *fixed.RISKS]
    told = tuple(map(tuple, rules))

    def scan(own: str | None, body: str | None) -> Iterator[tuple]:
        return _packs(told, examples).rows(own, body)

    rows = df.select(F.col(path).cast("string").alias("path"), F.col(column).alias("body"))
    if all(needles.needles(p) for _, p, _ in rules):
        some = sorted({n for _, p, _ in rules for n in needles.needles(p)})
        # The folded text is bound once; as a column it would be folded again for each string when the filter moves below it.
        rows = rows.filter(F.exists(F.array(needles.folded(F.col("body"))), lambda low: functools.reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in some])))
    return searched(rows, [], scan)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two sets of findings, one row for each rule, path, line and snippet."""
    return a.unionByName(b).dropDuplicates(["rule", "path", "line", "snippet_sha256"])


def code_lines(df: DataFrame, path: str, column: str) -> DataFrame:
    """(path, line, text) of each line, counted from 1."""
    return df.select(F.col(path).alias("path"), F.posexplode(text.lines(F.col(column))).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def spans_of(body: Column, pattern: str) -> Column:
    """(start, end) lines of each match of an expression that may go over line ends."""
    parts = F.split(F.regexp_replace(F.translate(body, "\x00", "\x01"), f"({pattern})", "\x00$1\x00"), "\x00")
    zero = F.struct(F.lit(1).alias("line"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, part: Column) -> Column:
        after = a["line"] + F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))
        out = F.when(a["inside"], F.array_append(a["out"], F.struct(a["line"].alias("start"), after.alias("end")))).otherwise(a["out"])
        return F.struct(after.alias("line"), (~a["inside"]).alias("inside"), out.alias("out"))

    return F.aggregate(parts, zero, step, lambda a: a["out"])


def is_comment(line: Column) -> Column:
    return F.trim(line).rlike(r"^(//|\*)")


def write_after(line: Column, following: Column) -> Column:
    """Of the lines after an external call, the place (from 1) of the first that writes state; null if none does.

    A line that only closes a brace ends the search; blank lines and comments are passed over, and so is a write after
    ``if (!flag) {``, which is reached only when the call failed.
    """
    zero = F.struct(F.lit(False).alias("stop"), F.lit(None).cast("int").alias("hit"), line.alias("seen"))

    def step(a: Column, x: Column) -> Column:
        t, n = x["text"], x["n"]
        ends = F.contains(t, F.lit("}")) & ~F.contains(t, F.lit("{"))
        void = (F.trim(t) == "") | F.startswith(F.trim(t), F.lit("//"))
        writes = t.rlike(fixed.STATE_WRITE) & ~F.contains(t, F.lit("==")) & ~a["seen"].rlike(fixed.FAILED_GUARD)
        hit = ~ends & ~void & writes
        return F.when(a["stop"], a).otherwise(F.struct((ends | hit).alias("stop"), F.when(hit, n).alias("hit"), F.concat(a["seen"], F.lit("\n"), t).alias("seen")))

    numbered = F.transform(F.array_compact(following), lambda t, i: F.struct(t.alias("text"), (i + 1).cast("int").alias("n")))
    return F.when(line.rlike(fixed.EXTERNAL_CALL), F.aggregate(numbered, zero, step, lambda a: a["hit"]))


def contract_findings(lines: DataFrame) -> DataFrame:
    """Contract rules on (path, line, text): one row for each rule and line; test paths weigh one step less.

    A value drawn from block variables over several lines covers the lines of the plain rule. An unchecked low-level call
    is one whose success is discarded, or not asked for within three lines. State written within twelve lines after an
    external call is open to reentry.
    """
    return _contracts(lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all")))


def contract_file_findings(files: DataFrame, path: str, column: str) -> DataFrame:
    """The same on whole files, each a row: its lines stay together, and only findings are shuffled."""
    return _contracts(files.select(F.col(path).alias("path"), F.transform(text.lines(F.col(column)), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"))).alias("all")))


def _contracts(whole: DataFrame) -> DataFrame:
    """Contract rules on (path, all), where ``all`` has the (line, text) of a file in order."""
    spans = spans_of(F.array_join(F.transform("all", lambda x: x["text"]), "\n"), fixed.SEED_OVER_LINES)

    def place(x: Column, i: Column) -> Column:
        following = F.transform(F.slice("all", i + 2, fixed.REENTRY_LINES), lambda y: y["text"])
        covered = F.exists("spans", lambda s: (s["start"] <= x["line"]) & (x["line"] <= s["end"]))
        begins = F.exists("spans", lambda s: s["start"] == x["line"])
        return F.struct(x["line"].alias("line"), x["text"].alias("text"), following.alias("next"), covered.alias("covered"), begins.alias("begins"))

    rows = whole.withColumn("spans", spans).select("path", F.explode(F.transform("all", place)).alias("x")).select("path", "x.*")
    t, line = F.col("text"), F.col("line")

    def found(when: Column, i: int, rule: str, severity: str, at: Column = line) -> Column:
        return F.when(when, F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule"), at.alias("line"), F.lit(severity).alias("severity")))

    free = {True: ~is_comment(t) & ~F.col("covered"), False: ~is_comment(t)}
    single = [found(free[p == fixed.BLOCK_VALUE] & t.rlike(p), i, r, s) for i, (r, s, p) in enumerate(fixed.CONTRACT)]
    var = F.regexp_extract(t, r"\(\s*bool\s+(\w+)\s*,", 1)
    rows = rows.withColumn("is_call", F.contains(t, F.lit(".call")) & ~F.startswith(F.trim(t), F.lit("//")))
    rows = rows.withColumn("var", F.when(F.col("is_call"), var)).withColumn("n", write_after(t, F.col("next")))
    # The name that was captured stands where the expression has a NUL.
    named = F.regexp_replace(F.array_join(F.slice("next", 1, 3), "\n"), F.concat(F.lit(r"\b"), F.col("var"), F.lit(r"\b")), "\x00")
    asked = named.rlike(r"require\s*\(\s*\x00|if\s*\(\s*!?\s*\x00")
    loose = F.when(F.col("var") != "", ~asked).otherwise(t.rlike(r"^\s*[^=;]+\.call\s*[({]"))
    hits = [
        found(F.col("begins"), -1, "weak_randomness", "high"), *single, found(F.col("is_call") & loose, 0, "unchecked_call", "high"),
        found(F.col("n").isNotNull(), 0, "reentrancy_state_after_call", "critical", line + F.col("n")),
    ]
    every = rows.select("path", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "h.*")
    every = every.groupBy("path", "rule", "line").agg(F.min(F.struct("i", "severity")).alias("h")).select("path", "rule", "line", F.col("h.severity").alias("severity"))
    order = F.array(*[F.lit(s) for s in fixed.SEVERITIES])
    milder = F.element_at(order, F.least(F.array_position(order, F.col("severity")).cast("int") + 1, F.lit(5)))
    return every.withColumn("severity", F.when(F.col("path").rlike(fixed.CONTRACT_TEST_PATH), milder).otherwise(F.col("severity")))


def brace_depth(body: Column) -> Column:
    """Deepest nesting of braces; closing ones beyond the opened count as none."""
    return F.aggregate(
        F.regexp_extract_all(body, F.lit("[{}]"), F.lit(0)),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda a, c: F.struct(F.when(c == "{", a["d"] + 1).otherwise(F.greatest(a["d"] - 1, F.lit(0))).alias("d"), F.greatest(a["m"], F.when(c == "{", a["d"] + 1).otherwise(a["m"])).alias("m")),
        lambda a: a["m"],
    ).cast("long")
