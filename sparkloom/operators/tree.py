"""Source trees: what a path says about a file, and every rule pack on each file in one Arrow pass.

Paths are relative, with slashes; a null path has no class. Bodies are text; a null body has no finding. Repeated rows
give repeated findings, and columns beside those named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import fixed, packs, text
from sparkloom.functions.needles import fold, hints, longest, needles, solid
from sparkloom.operators import scan, state

#: Findings kept of one tree, and hot spots, dependencies and paths of each class.
MOST_FINDINGS, MOST_HOTSPOTS, MOST_SUPPRESSIONS = 120, 12, 20


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def end(path: Column) -> Column:
    """The last dot of a file's name and what follows it; a name's leading dots begin no end."""
    return F.regexp_extract(base(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    """Language by whole name, by name in any case, then by end; null if none is known."""
    folded: dict[str, str] = {}
    for name, value in packs.LANGUAGE_BY_NAME.items():
        folded.setdefault(name.lower(), value)
    by_name, by_folded, by_end = _map(packs.LANGUAGE_BY_NAME), _map(folded), _map(packs.LANGUAGE_BY_END)
    tail = end(path)
    return F.coalesce(
        F.try_element_at(by_name, base(path)), F.try_element_at(by_folded, F.lower(base(path))), F.try_element_at(by_end, F.lower(tail)), F.try_element_at(by_end, tail)
    )


def ecosystem(path: Column) -> Column:
    """Ecosystem of a manifest by its name in lower case, or by its end; null if it is none."""
    name = F.lower(base(path))
    whole = {k.lower(): v for k, v in packs.MANIFESTS.items() if "*" not in k}
    ends = [F.when(F.endswith(name, F.lit(k.replace("*", ""))), v) for k, v in packs.MANIFESTS.items() if "*" in k]
    return F.coalesce(F.try_element_at(_map(whole), name), *ends)


def _any(value: Column, patterns: Iterable[str]) -> Column:
    return functools.reduce(Column.__or__, [value.rlike(scan.java(p)) for p in patterns])


def is_test(path: Column) -> Column:
    return _any(path, packs.TESTS) | _any(base(path), packs.TESTS)


def is_continuous(path: Column) -> Column:
    return _any(path, packs.CONTINUOUS)


def is_infrastructure(path: Column) -> Column:
    return _any(path, packs.INFRASTRUCTURE)


def is_lockfile(path: Column) -> Column:
    return F.lower(base(path)).isin(*packs.LOCKFILES)


def is_license(path: Column) -> Column:
    return base(path).rlike(scan.java(packs.LICENSE_NAME))


def is_secret_only(path: Column) -> Column:
    return F.lower(base(path)).isin(*packs.SECRET_NAMES)


def is_prose(path: Column) -> Column:
    return F.lower(end(path)).isin(*packs.PROSE_ENDS)


def is_key_file(path: Column) -> Column:
    """A known name, in lower case as the list of names has it, that is no test and has a language."""
    name = F.lower(base(path))
    return language(path).isNotNull() & ~is_test(path) & name.isin(*packs.LANGUAGE_BY_NAME, *packs.KEY_FILES)


def is_readable(path: Column) -> Column:
    """Whether a file of this path is read at all."""
    tail = F.lower(end(path))
    known = tail.isin(*packs.LANGUAGE_BY_END, *packs.SECRET_ENDS) | language(path).isNotNull() | ecosystem(path).isNotNull()
    return known | is_continuous(path) | is_infrastructure(path) | is_license(path) | is_lockfile(path) | is_secret_only(path)


def is_skipped(path: Column) -> Column:
    """Whether a directory on the way is one that is not read."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*packs.SKIPPED_DIRS) | F.startswith(d, F.lit(".venv")))


def _inside(path: Column, names: tuple[str, ...]) -> Column:
    steps = F.split(path, "/")
    return F.exists(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), lambda d: d.isin(*names))


def is_node_file(path: Column) -> Column:
    """Whether the nodes of an audit read a file."""
    return (F.lower(end(path)).isin(*fixed.NODE_ENDS) | base(path).isin(*fixed.NODE_NAMES)) & ~_inside(path, fixed.NODE_SKIPPED)


def is_contract(path: Column) -> Column:
    return F.endswith(path, F.lit(".sol")) & ~_inside(path, fixed.CONTRACT_SKIPPED)


def is_code(path: Column) -> Column:
    """Whether a file is in the import graph."""
    return F.lower(end(path)).isin(*[f".{e}" for e in fixed.AUDIT_ENDS]) & ~is_skipped(path)


def is_deep_test(path: Column) -> Column:
    return base(path).rlike(fixed.DEEP_TEST_NAME) | path.rlike(fixed.DEEP_TEST_DIR)


def entrypoint(lang: Column, body: Column) -> Column:
    """Whether a file of just this language starts a program."""
    return F.coalesce(functools.reduce(Column.__or__, [(lang == of) & body.rlike(scan.java(p)) for p, of in packs.ENTRYPOINTS]), F.lit(False))


class Rule(NamedTuple):
    id: str
    pattern: str
    score: int
    #: Why it matters; a secret has its own masked text instead.
    reason: str | None
    #: Whether it fires in prose.
    prose: bool


def supply_id(reason: str) -> str:
    return "supply:" + re.sub(r"\W+", "_", reason)[:40]


SECRETS = [Rule(f"secret:{name}", p, score, None, True) for name, p, score in packs.SECRETS]
COMMON = [Rule(f"risk:{name}", p, score, why, False) for name, p, score, why in packs.COMMON]
SUPPLY = [Rule(supply_id(why), p, score, why, False) for why, p, score in fixed.SUPPLY]


def pack_of(lang: str | None) -> list[Rule]:
    """Rules of a language, or of the one whose pack it takes."""
    pack = packs.BY_LANGUAGE.get(lang or "") or packs.BY_LANGUAGE.get(packs.PACK_OF.get(lang or "", ""), [])
    return [Rule(f"risk:{name}", p, score, why, False) for name, p, score, why in pack]


def rules_for(lang: str | None) -> list[Rule]:
    """Every rule that can fire in a file of a language, in the order they are tried."""
    return [*SECRETS, *COMMON, *pack_of(lang), *SUPPLY]


class Scanner:
    """Compiled rules of each language, and the strings that a text must have for a rule to be tried."""

    def __init__(self) -> None:
        self.packs: dict[str | None, list] = {}
        self.secrets = [(re.compile(r.pattern), needles(r.pattern)) for r in SECRETS]
        self.example = re.compile(fixed.EXAMPLE)

    def pack(self, lang: str | None) -> list:
        if lang not in self.packs:
            self.packs[lang] = [(r, re.compile(r.pattern), hints(r.pattern), solid(r.pattern)) for r in rules_for(lang)]
        return self.packs[lang]

    def masked(self, line: str) -> str:
        """A line whose secrets are masked one after the other, in the order of the rules, cut at 200."""
        low = fold(line)
        for pattern, some in self.secrets:
            if some and not any(n in low for n in some):
                continue
            for m in pattern.finditer(line):
                if not self.example.search(m[0]):
                    line = line.replace(m[0], scan._masked(m[0]), 1)
        return line.strip()[:200]

    def rows(self, path: str, lang: str | None, prose: bool, body: str) -> Iterator[tuple]:
        low, shown, most = fold(body), None, longest(body)
        for rule, pattern, some, least in self.pack(lang):
            if (prose and not rule.prose) or least > most or (some and not any(n in low for n in some)):
                continue
            for m in pattern.finditer(body):
                if rule.reason is None and self.example.search(m[0]):
                    continue
                shown = body.splitlines() if shown is None else shown
                line = body.count("\n", 0, m.start()) + 1
                if line > len(shown):
                    continue
                snippet = self.masked(shown[line - 1])
                digest = hashlib.sha256(snippet.encode("utf-8", "surrogatepass")).hexdigest()
                receipt = hashlib.sha256(f"{rule.id}|{path}|{line}|{digest}".encode("utf-8", "surrogatepass")).hexdigest()[:16]
                severity = next(s for at_least, s in ((90, "critical"), (70, "high"), (30, "medium"), (-1, "low")) if rule.score >= at_least)
                yield path, rule.id, severity, line, rule.reason or scan._masked(m[0]), snippet, digest, f"sha256:{receipt}"


@functools.cache
def _scanner() -> Scanner:
    """One for each worker: compiling the rules takes longer than most partitions."""
    return Scanner()


def findings(df: DataFrame, path: str = "path", body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Every match of every rule that applies to a file: secrets anywhere, the rest outside prose; columns to ``keep`` stand first."""
    keep = keep or []

    def find(own: str, lang: str | None, prose: bool, text: str) -> Iterator[tuple]:
        return _scanner().rows(own, lang, prose, text)

    p = F.col(path).cast("string")
    rows = df.select(*keep, p.alias("path"), language(p).alias("lang"), is_prose(p).alias("prose"), F.col(body).cast("string").alias("body"))
    return scan.searched(rows.filter("path is not null and body is not null"), keep, find)


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), severity)


def ordered(found: DataFrame, tree: str, most: int = MOST_FINDINGS) -> DataFrame:
    """The first ``most`` findings of each tree, worst first, with their place and whether others were cut."""
    by = Window.partitionBy(tree).orderBy(rank(F.col("severity")), "path", "line", "rule", "snippet_sha256")
    # One more row of each tree tells whether others were cut, so the findings are made once.
    placed = found.filter(F.col(tree).isNotNull()).withColumn("place", F.row_number().over(by).cast("long")).filter(F.col("place") <= most + 1)
    return placed.withColumn("truncated", F.max("place").over(Window.partitionBy(tree)) > most).filter(F.col("place") <= most)


def most(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``place``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")).filter(F.col("place") <= k)


def python_functions(df: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(path, name, line, length) of each ``def``, which begins with the blank lines before it.

    It ends where the next one begins; the last one at the first line indented no more than it, blank lines before it and
    their line ends counted as indent, else at the file's end.
    """
    lines = scan.code_lines(df, path, body).withColumn("n", F.length("text"))
    along = Window.partitionBy("path").orderBy("line")
    placed = lines.withColumn("end", F.sum(F.col("n") + 1).over(along)).withColumn("lines", F.max("line").over(Window.partitionBy("path")))
    solid = placed.filter(F.col("text").rlike(r"\S")).withColumn("indent", F.length(F.regexp_extract("text", r"^(\s*)", 1)))
    solid = solid.withColumn("from", F.coalesce(F.lag("line").over(along), F.lit(0)) + 1).withColumn("before", F.coalesce(F.lag("end").over(along), F.lit(0)))
    name = F.regexp_extract("text", scan.java(r"^\s*(?:async\s+)?def\s+(\w+)"), 1)
    own = F.col("end") - F.col("n") - 1 + F.col("indent") - F.col("before")
    defs = solid.select("path", name.alias("name"), "from", own.alias("own"), "lines").filter("name <> ''")
    defs = defs.withColumn("next", F.lead("from").over(Window.partitionBy("path").orderBy("from")))
    last = defs.filter("next is null").select("path", F.col("from").alias("start"), "own")
    back = solid.select("path", "line", "indent").join(last, "path").filter("line > start and indent <= own").groupBy("path").agg(F.min("line").alias("back"))
    length = F.coalesce("next", "back", F.col("lines") + 1) - F.col("from")
    return defs.join(back, "path", "left").select("path", "name", F.col("from").cast("long").alias("line"), length.cast("long").alias("length"))


def hotspots(df: DataFrame, tree: str, path: str = "path", body: str = "body", most: int = MOST_HOTSPOTS) -> DataFrame:
    """(tree, path, score, decisions, depth, place): decision points, twice the depth of braces, 10 for each long Python function."""
    lang = language(F.col(path))
    rows = df.select(F.col(tree).alias(tree), F.col(path).alias("path"), lang.alias("lang"), F.col(body).alias("body"))
    rows = rows.filter(F.coalesce(~F.col("lang").isin(*packs.NOT_CODE), F.lit(True)) & ~is_prose(F.col("path")))
    long = python_functions(rows.filter("lang = 'Python'")).filter("length >= 60").groupBy("path").agg((F.count("*") * 10).alias("long"))
    depth = F.when(F.coalesce(F.col("lang") == "Python", F.lit(False)), F.lit(0).cast("long")).otherwise(scan.brace_depth(F.col("body")))
    scored = rows.select(tree, "path", text.matches(F.col("body"), fixed.DECISION).alias("decisions"), depth.alias("depth")).join(long, "path", "left")
    scored = scored.withColumn("score", F.col("decisions") + 2 * F.col("depth") + F.coalesce("long", F.lit(0))).filter("score > 0")
    place = F.row_number().over(Window.partitionBy(tree).orderBy(F.desc("score"), "path"))
    return scored.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select(tree, "path", "score", "decisions", "depth", "place")


def inventory(df: DataFrame, tree: str, path: str = "path", body: str = "body") -> DataFrame:
    """One row for each tree: files, lines, sorted paths of each class, markers, and notes on what it lacks."""
    p, b = F.col(path), F.coalesce(F.col(body), F.lit(""))
    lang = language(p)

    def paths(fits: Column, most: int) -> Column:
        return F.slice(F.array_sort(F.collect_set(F.when(fits, p))), 1, most)

    ends = lambda *names: F.max(functools.reduce(Column.__or__, [F.endswith(p, F.lit(n)) for n in names]) & is_lockfile(p))
    rows = df.groupBy(tree).agg(
        F.count("*").alias("files"), F.sum(F.size(F.filter(text.lines(b), lambda x: F.trim(x) != ""))).alias("loc"), F.count_distinct(lang).alias("languages"),
        paths(entrypoint(lang, b), 40).alias("entrypoints"), paths(is_continuous(p), 40).alias("continuous"), paths(is_infrastructure(p), 60).alias("infrastructure"),
        paths(is_test(p), 60).alias("tests"), paths(is_lockfile(p), 40).alias("lockfiles"), paths(is_license(p), 10).alias("licenses"), paths(is_key_file(p), 40).alias("key_files"),
        F.sum(text.matches(b, r"\bTODO\b")).alias("todos"), F.sum(text.matches(b, r"\bFIXME\b")).alias("fixmes"), F.sum(text.matches(b, fixed.SUPPRESSION)).alias("suppressions"),
        F.max(lang.isin("JavaScript", "TypeScript")).alias("node"), ends("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json").alias("node_lock"),
        F.max(lang == "Python").alias("python"), ends("poetry.lock", "Pipfile.lock", "uv.lock", "pdm.lock").alias("python_lock"),
    )
    said = fixed.NOTES
    notes = [
        F.when(F.coalesce("node", F.lit(False)) & ~F.coalesce("node_lock", F.lit(False)), said["node"]), F.when(F.coalesce("python", F.lit(False)) & ~F.coalesce("python_lock", F.lit(False)), said["python"]),
        F.when(F.size("licenses") == 0, said["license"]), F.when(F.size("tests") == 0, said["tests"]), F.when(F.size("continuous") == 0, said["continuous"]),
    ]
    dotenv = F.transform(F.filter("infrastructure", lambda x: F.lower(x).rlike(r"\.env(rc)?$")), lambda x: F.concat(x, F.lit(said["dotenv"])))
    many = F.when(F.col("suppressions") > MOST_SUPPRESSIONS, F.concat(F.col("suppressions").cast("string"), F.lit(said["suppressions"])))
    return rows.withColumn("notes", F.array_compact(F.concat(F.array(*notes), dotenv, F.array(many)))).drop("node", "node_lock", "python", "python_lock")


def within_budget(df: DataFrame, tree: str, path: str, size: str, most_files: int = 1500, each: int = 300_000, total: int = 24_000_000) -> DataFrame:
    """``df`` with ``admitted``: in order of path, a file that is too large or no longer fits is passed over, later ones may fit."""

    def start() -> list[int]:
        return [0, 0]

    def step(held: list[int], row: tuple) -> bool:
        n = row[0]
        fits = held[0] < most_files and n is not None and n <= each and held[1] + n <= total
        if fits:
            held[0], held[1] = held[0] + 1, held[1] + n
        return bool(fits)

    return state.folded(df, [tree], [path], [size], start, step, "admitted boolean")
