"""Queries on trees of source files. The files are made of the documents: each gets a path and a line that a rule looks for."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed, packs
from sparkloom.operators import imports, scan, tree
from sparkloom.plans.registry import query, re2
from sparkloom.plans.samples import sample
from sparkloom.session import table

#: Paths, with the document's id for the braces.
PATHS = [
    "src/f{}.py", "src/f{}.js", "src/f{}.ts", "img{}/Dockerfile", "cmd/f{}.go", "docs/d{}.md", "p{}/requirements.txt", "contracts/C{}.sol", "deploy{}/main.tf", "lib/f{}.rb", "e{}/.env", "p{}/package.json",
    "tests/t{}_test.py", "l{}/LICENSE", "n{}/yarn.lock", "src/F{}.java", "web/f{}.php", "src/f{}.rs", "src/f{}.c", "bin/f{}.sh", "src/F{}.cs", "k8s/f{}.yml", ".github/workflows/w{}.yml", "misc/noend{}",
    "db/f{}.sql", "win/F{}.PS1", "src/f{}.kt", "keys{}/id_rsa", "g{}/GEMFILE", "s{}/x.gemspec", "src/f{}.ex", "src/f{}.pl", "src/f{}.lua", "src/f{}.move", "src/f{}.cairo", "nix/f{}.nix", "src/f{}.jl",
    "src/f{}.dart", "src/f{}.swift", "src/f{}.groovy", "nb/f{}.ipynb", "src/f{}.erl", "cfg/f{}.xml", "src/F{}.cpp", "a{}/poetry.lock", "q/{}.R",
]
RULES = [*tree.SECRETS, *tree.COMMON, *tree.SUPPLY, *(r for lang in packs.BY_LANGUAGE for r in tree.pack_of(lang))]
#: Added to every file with a Python path, more of it the larger its id.
FUNCTIONS = "\ndef f(x):\n    if x {and} x:\n        return 1\n\n\nasync def g(y):\n" + "    y += 1\n" * 61 + "\nz = {1: {2: 3}}  # TODO noqa\n"


@functools.cache
def _plants() -> list[str]:
    """A line for each rule."""
    return [sample(r.pattern) for r in RULES]


def _text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@functools.cache
def files_sql() -> str:
    """The same files as a subquery (doc_id, tree, path, body)."""
    pick = lambda items, at: f"list_value({', '.join(map(_text_sql, items))})[1 + {at} % {len(items)}]"
    return f"(SELECT doc_id, concat('r', doc_id % 7) AS tree, replace({pick(PATHS, 'doc_id')}, '{{}}', doc_id::VARCHAR) AS path, concat(text, chr(10), {pick(_plants(), '(doc_id * 31)')}, CASE WHEN doc_id % {len(PATHS)} IN (0, 12) THEN repeat({_text_sql(FUNCTIONS)}, (1 + doc_id % 3)::INT) ELSE '' END) AS body FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at % len(items) + 1).cast("int"))
    d = F.col("doc_id")
    path = F.replace(pick(PATHS, d), F.lit("{}"), d.cast("string"))
    more = F.when((d % len(PATHS)).isin(0, 12), F.repeat(F.lit(FUNCTIONS), (d % 3 + 1).cast("int"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("r"), (d % 7).cast("string")).alias("tree"), path.alias("path"), F.concat("text", F.lit("\n"), pick(_plants(), d * 31), more).alias("body"))


BASE = "regexp_extract(path, '([^/]*)$', 1)"
END = f"regexp_extract({BASE}, '(?s)^\\.*[^.].*(\\.[^.]*)$', 1)"


def _map_sql(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_text_sql(k)}: {_text_sql(v)}" for k, v in pairs.items()) + "}"


def _in_sql(value: str, items: tuple[str, ...]) -> str:
    return f"coalesce(list_contains({list(items)}, {value}), false)"


def _matches_sql(value: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({value}, '{re2(p)}')" for p in patterns) + ")"


@functools.cache
def classes_sql() -> str:
    """(doc_id, tree, path, body, and the classes of each path)."""
    lower_names: dict[str, str] = {}
    for name, value in packs.LANGUAGE_BY_NAME.items():
        lower_names.setdefault(name.lower(), value)
    lang = f"coalesce({_map_sql(packs.LANGUAGE_BY_NAME)}[{BASE}], {_map_sql(lower_names)}[lower({BASE})], {_map_sql(packs.LANGUAGE_BY_END)}[lower({END})], {_map_sql(packs.LANGUAGE_BY_END)}[{END}])"
    whole = {k.lower(): v for k, v in packs.MANIFESTS.items() if "*" not in k}
    ends = " ".join(f"WHEN ends_with(lower({BASE}), '{k.replace('*', '')}') THEN '{v}'" for k, v in packs.MANIFESTS.items() if "*" in k)
    return f"""(SELECT *, {_in_sql(f'lower({END})', (*packs.LANGUAGE_BY_END, *packs.SECRET_ENDS))} OR language IS NOT NULL OR eco IS NOT NULL OR ci OR iac OR is_license OR lockfile OR secret_only AS readable FROM (
      SELECT doc_id, tree, path, body, {lang} AS language, coalesce({_map_sql(whole)}[lower({BASE})], CASE {ends} END) AS eco, {_matches_sql('path', packs.TESTS)} OR {_matches_sql(BASE, packs.TESTS)} AS test,
        {_matches_sql('path', packs.CONTINUOUS)} AS ci, {_matches_sql('path', packs.INFRASTRUCTURE)} AS iac, {_in_sql(f'lower({BASE})', packs.LOCKFILES)} AS lockfile, regexp_matches({BASE}, '{re2(packs.LICENSE_NAME)}') AS is_license,
        {_in_sql(f'lower({BASE})', packs.SECRET_NAMES)} AS secret_only, {_in_sql(f'lower({END})', packs.PROSE_ENDS)} AS prose FROM {files_sql()}))"""


@query(f"SELECT doc_id, path, language, eco, test, ci, iac, lockfile, is_license, secret_only, prose, readable FROM {classes_sql()}")
def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return files(spark, sf_dir).select(
        "doc_id", "path", tree.language(p).alias("language"), tree.ecosystem(p).alias("eco"), tree.is_test(p).alias("test"), tree.is_continuous(p).alias("ci"), tree.is_infrastructure(p).alias("iac"),
        tree.is_lockfile(p).alias("lockfile"), tree.is_license(p).alias("is_license"), tree.is_secret_only(p).alias("secret_only"), tree.is_prose(p).alias("prose"), tree.is_readable(p).alias("readable"),
    )


@query(f"SELECT tree, language, count(*)::BIGINT AS files, row_number() OVER (PARTITION BY tree ORDER BY count(*) DESC, language)::BIGINT AS place FROM {classes_sql()} WHERE language IS NOT NULL GROUP BY tree, language QUALIFY place <= 12")
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent languages of each tree."""
    return tree.most(files(spark, sf_dir).withColumn("language", tree.language(F.col("path"))).filter("language is not null").groupBy("tree", "language").agg(F.count("*").alias("files")), ["tree"], [F.desc("files"), F.col("language")], 12)


LOOKS = ("(?=", "(?!", "(?<")


def _hits_sql() -> str:
    """Matches of each rule that needs no look-around, where it applies."""

    def listed(rules: list[tree.Rule]) -> str:
        own = [r for r in rules if not any(x in r.pattern for x in LOOKS)]
        one = lambda r: f"regexp_extract_all(body, '{re2(r.pattern)}')"
        real = lambda r: one(r) if r.reason else f"list_filter({one(r)}, lambda m: NOT regexp_matches(m, '{re2(fixed.EXAMPLE)}'))"
        return "[" + ", ".join(f"{{rule: '{r.id}', n: len({real(r)})}}" for r in own) + "]"

    none = "[]::STRUCT(rule VARCHAR, n BIGINT)[]"
    langs = sorted({*packs.BY_LANGUAGE, *(k for k in packs.PACK_OF if tree.pack_of(k))})
    by_lang = " ".join(f"WHEN '{lang}' THEN {listed(tree.pack_of(lang))}" for lang in langs)
    hits = f"list_concat({listed(tree.SECRETS)}, CASE WHEN prose THEN {none} ELSE list_concat({listed([*tree.COMMON, *tree.SUPPLY])}, CASE language {by_lang} ELSE {none} END) END)"
    return f"SELECT doc_id, h.rule AS rule, sum(h.n)::BIGINT AS n FROM (SELECT doc_id, unnest({hits}) AS h FROM {classes_sql()}) WHERE h.n > 0 GROUP BY doc_id, h.rule"


@query(_hits_sql())
def file_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule fires in each file, of the rules that SQL can state; ``file_findings`` has all."""
    told = [r.id for r in RULES if not any(x in r.pattern for x in LOOKS)]
    dark = {r.id for r in RULES if any(x in r.pattern for x in LOOKS)}
    found = tree.findings(files(spark, sf_dir), keep=["doc_id"]).filter(F.col("rule").isin(*told) & ~F.col("rule").isin(*dark))
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query()
def file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 120 findings of each tree, worst first, masked and with receipts."""
    return tree.ordered(tree.findings(files(spark, sf_dir), keep=["tree"]), "tree")


LINES_SQL = "(SELECT doc_id, tree, path, pos AS line, ls[pos] AS t FROM (SELECT doc_id, tree, path, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, tree, path, CASE WHEN ends_with(body, chr(10)) THEN string_split(body, chr(10))[:-2] ELSE string_split(body, chr(10)) END AS ls FROM {files} WHERE ends_with(path, '.py'))))"
FUNCTIONS_SQL = f"""WITH l AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY path ORDER BY line) AS upto, max(line) OVER (PARTITION BY path) AS n_lines FROM {LINES_SQL.format(files=files_sql())}),
  s AS (SELECT *, length(regexp_extract(t, '^(\\s*)', 1)) AS indent, coalesce(lag(line) OVER w, 0) + 1 AS begins, coalesce(lag(upto) OVER w, 0) AS before FROM l WHERE regexp_matches(t, '\\S') WINDOW w AS (PARTITION BY path ORDER BY line)),
  d AS (SELECT doc_id, tree, path, begins, n_lines, regexp_extract(t, '^\\s*(?:async\\s+)?def\\s+(\\w+)', 1) AS name, upto - length(t) - 1 + indent - before AS own FROM s WHERE regexp_matches(t, '^\\s*(?:async\\s+)?def\\s+(\\w+)')),
  n AS (SELECT *, lead(begins) OVER (PARTITION BY path ORDER BY begins) AS nxt FROM d),
  b AS (SELECT n.path, min(s.line) AS back FROM n JOIN s ON s.path = n.path AND s.line > n.begins AND s.indent <= n.own WHERE n.nxt IS NULL GROUP BY n.path),
  f AS (SELECT doc_id, tree, n.path, name, begins::BIGINT AS line, (coalesce(nxt, back, n_lines + 1) - begins)::BIGINT AS length FROM n LEFT JOIN b ON n.path = b.path)"""


@query(f"{FUNCTIONS_SQL} SELECT path, name, line, length FROM f")
def file_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.python_functions(files(spark, sf_dir).filter(F.endswith("path", F.lit(".py"))))


@query(f"""{FUNCTIONS_SQL}, c AS (SELECT tree, path, len(regexp_extract_all(body, '{re2(fixed.DECISION)}')) AS decisions,
    CASE WHEN language = 'Python' THEN 0 ELSE coalesce(list_reduce(regexp_extract_all(body, '[{{}}]'), lambda a, x: {{d: CASE WHEN x.d > 0 THEN a.d + 1 ELSE greatest(a.d - 1, 0) END, m: greatest(a.m, CASE WHEN x.d > 0 THEN a.d + 1 ELSE a.m END)}}, {{d: 0, m: 0}}).m, 0) END AS depth
  FROM {classes_sql()} WHERE NOT prose AND (language IS NULL OR NOT list_contains({list(packs.NOT_CODE)}, language))),
  g AS (SELECT path, 10 * count(*) AS long FROM f WHERE length >= 60 GROUP BY path), h AS (SELECT tree, c.path, decisions + 2 * depth + coalesce(long, 0) AS score, decisions, depth FROM c LEFT JOIN g ON c.path = g.path)
  SELECT tree, path, score::BIGINT AS score, decisions::BIGINT AS decisions, depth::BIGINT AS depth, row_number() OVER (PARTITION BY tree ORDER BY score DESC, path)::BIGINT AS place FROM h WHERE score > 0 QUALIFY place <= 12""".replace("list_reduce(regexp_extract_all(body, '[{}]')", "list_reduce(list_transform(regexp_extract_all(body, '[{}]'), lambda z: {d: CASE WHEN z = '{' THEN 1 ELSE 0 END, m: 0})"))
def file_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.hotspots(files(spark, sf_dir), "tree")


def _paths_sql(fits: str, most: int) -> str:
    return f"coalesce(list_sort(list(DISTINCT path) FILTER ({fits}))[:{most}], []::VARCHAR[])"


ENTRY_SQL = "coalesce(" + " OR ".join(f"(language = '{lang}' AND regexp_matches(body, '{re2(p)}'))" for p, lang in packs.ENTRYPOINTS) + ", false)"
KEYS_SQL = f"language IS NOT NULL AND NOT test AND list_contains({[*packs.LANGUAGE_BY_NAME, *packs.KEY_FILES]}, lower({BASE}))"


@query(f"""WITH c AS (SELECT tree, count(*)::BIGINT AS files, sum(len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')))::BIGINT AS loc, count(DISTINCT language)::BIGINT AS languages,
    {_paths_sql(ENTRY_SQL, 40)} AS entrypoints, {_paths_sql('ci', 40)} AS continuous, {_paths_sql('iac', 60)} AS infrastructure, {_paths_sql('test', 60)} AS tests, {_paths_sql('lockfile', 40)} AS lockfiles,
    {_paths_sql('is_license', 10)} AS licenses, {_paths_sql(KEYS_SQL, 40)} AS key_files, sum(len(regexp_extract_all(body, '\\bTODO\\b')))::BIGINT AS todos, sum(len(regexp_extract_all(body, '\\bFIXME\\b')))::BIGINT AS fixmes,
    sum(len(regexp_extract_all(body, '{fixed.SUPPRESSION}')))::BIGINT AS suppressions, bool_or(coalesce(language IN ('JavaScript', 'TypeScript'), false)) AS node, bool_or(coalesce(language = 'Python', false)) AS python,
    bool_or(lockfile AND regexp_matches(path, '(package-lock.json|yarn.lock|pnpm-lock.yaml|npm-shrinkwrap.json)$')) AS node_lock, bool_or(lockfile AND regexp_matches(path, '(poetry.lock|Pipfile.lock|uv.lock|pdm.lock)$')) AS python_lock
  FROM {classes_sql()} GROUP BY tree)
  SELECT tree, files, loc, languages, array_to_string(entrypoints, ',') AS entrypoints, len(continuous)::BIGINT AS continuous, len(infrastructure)::BIGINT AS infrastructure, len(tests)::BIGINT AS tests, array_to_string(lockfiles, ',') AS lockfiles,
    array_to_string(licenses, ',') AS licenses, array_to_string(key_files, ',') AS key_files, todos, fixmes, suppressions,
    array_to_string(list_filter(list_concat([CASE WHEN node AND NOT node_lock THEN '{fixed.NOTES['node']}' END, CASE WHEN python AND NOT python_lock THEN '{fixed.NOTES['python']}' END, CASE WHEN len(licenses) = 0 THEN '{fixed.NOTES['license']}' END,
      CASE WHEN len(tests) = 0 THEN '{fixed.NOTES['tests']}' END, CASE WHEN len(continuous) = 0 THEN '{fixed.NOTES['continuous']}' END], list_transform(list_filter(infrastructure, lambda x: regexp_matches(lower(x), '\\.env(rc)?$')), lambda x: concat(x, '{fixed.NOTES['dotenv']}')),
      [CASE WHEN suppressions > 20 THEN concat(suppressions, '{fixed.NOTES['suppressions']}') END]), lambda x: x IS NOT NULL), ';') AS notes FROM c""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.inventory(files(spark, sf_dir), "tree")
    joined = lambda name: F.array_join(name, ",").alias(name)
    sized = lambda name: F.size(name).cast("long").alias(name)
    return rows.select(
        "tree", "files", F.col("loc").cast("long").alias("loc"), "languages", joined("entrypoints"), sized("continuous"), sized("infrastructure"), sized("tests"), joined("lockfiles"), joined("licenses"), joined("key_files"), "todos", "fixmes", "suppressions",
        F.array_join("notes", ";").alias("notes"),
    )


@query(f"""WITH RECURSIVE o AS (SELECT tree, path, octet_length(encode(body)) AS size, row_number() OVER (PARTITION BY tree ORDER BY path) AS n FROM {files_sql()}),
  f AS (SELECT tree, 0::BIGINT AS n, 0::BIGINT AS files, 0::BIGINT AS total FROM (SELECT DISTINCT tree FROM o)
    UNION ALL SELECT o.tree, o.n, f.files + fits::BIGINT, f.total + CASE WHEN fits THEN o.size ELSE 0 END FROM f JOIN o ON o.tree = f.tree AND o.n = f.n + 1, LATERAL (SELECT f.files < 100 AND o.size <= 20000 AND f.total + o.size <= 150000 AS fits))
  SELECT tree, max(files)::BIGINT AS files, max(total)::BIGINT AS bytes FROM f GROUP BY tree""")
def file_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a scan admits: one that is too large or does not fit is passed over, later ones may fit."""
    sized = files(spark, sf_dir).select("tree", "path", F.octet_length("body").cast("long").alias("size"))
    admitted = tree.within_budget(sized, "tree", "path", "size", 100, 20_000, 150_000)
    size = F.when(F.col("admitted"), F.col("size")).otherwise(0)
    return admitted.groupBy("tree").agg(F.count_if("admitted").alias("files"), F.sum(size).alias("bytes"))


BAD = """pragma solidity ^0.8.0;
contract C {
  function f() public {
    require(tx.origin == owner);
    (bool ok, ) = a.call{value: 1}("");
    x = 1;
    y = 2;
    z = 3;
    selfdestruct(owner);
  }
  function g() external {
    uint s = uint(keccak256(abi.encodePacked(
      seed,
      block.prevrandao
    )));
    // block.difficulty in a comment
    uint d = block.difficulty;
    for (uint i = 0; i < list.length; i++) { token.transfer(list[i]); }
    payable(a).send(1);
    balances[msg.sender] -= 1;
  }
}"""
GOOD = """pragma solidity 0.8.20;
contract C {
  function f() external {
    balances[msg.sender] = 0;
    // tx.origin == is bad
    (bool ok, ) = a.call{value: 1}("");
    if (!ok) {
      paid = false;
    }
    require(ok);
  }
  function h() external {
    (bool done, ) = b.call("");

    if ( ! done ) revert();
  }
}"""
ODD = """  a.call("");
  }
  x = 1;
contract D { function initialize() public {} }
  IERC20(t).safeTransfer(a, 1);

  // note
  if (x == y) { z = 1; }
  total += 1;
  (bool fine, ) = c.call{value: 2}("");
  finest = true;
  require(finest);
  b.delegatecall(data); assembly { } unchecked { }"""
CONTRACT_BODIES, CONTRACT_PATHS = [BAD, GOOD, ODD], ["src/C{}.sol", "test/C{}.t.sol", "src/MockC{}.sol", "contracts/C{}.sol"]
CONTRACTS_SQL = f"(SELECT doc_id, replace({[*CONTRACT_PATHS]}[1 + doc_id % 4], '{{}}', doc_id::VARCHAR) AS path, concat(list_value({', '.join(map(_text_sql, CONTRACT_BODIES))})[1 + doc_id % 3], chr(10), '// ', left(text, 40)) AS body FROM documents)"


def contract_sql(rows: str) -> str:
    """Contract rules on files (path, body)."""
    single = ", ".join(f"{{i: {i}, rule: '{r}', severity: '{s}', hit: regexp_matches(t, '{re2(p)}')}}" for i, (r, s, p) in enumerate(fixed.CONTRACT))
    block = next(i for i, (_, _, p) in enumerate(fixed.CONTRACT) if p == fixed.BLOCK_VALUE)
    ranks = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(fixed.SEVERITIES, [*fixed.SEVERITIES[1:], "info"], strict=True))
    return f"""WITH f AS (SELECT path, body, string_split(body, chr(10)) AS ls FROM {rows}), l AS (SELECT path, line, ls[line] AS t, ls[line + 1:line + 3] AS near, ls[line + 1:line + {fixed.REENTRY_LINES}] AS nxt FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS line FROM f)),
  m AS (SELECT path, unnest(list_zip(string_split_regex(body, '{re2(fixed.SEED_OVER_LINES)}')[:-2], regexp_extract_all(body, '{re2(fixed.SEED_OVER_LINES)}'))) AS z, body FROM f),
  sp AS (SELECT path, 1 + length(before) - length(replace(before, chr(10), '')) AS a, 1 + length(before || hit) - length(replace(before || hit, chr(10), '')) AS b FROM (SELECT path, z[2] AS hit, left(body, position(z[2] IN body) - 1) AS before FROM m)),
  s AS (SELECT path, line, h.i AS i, h.rule AS rule, h.severity AS severity FROM (SELECT path, line, unnest([{single}]) AS h FROM l WHERE NOT regexp_matches(trim(t), '^(//|\\*)')) WHERE h.hit),
  v AS (SELECT path, line, t, regexp_extract(t, '\\(\\s*bool\\s+(\\w+)\\s*,', 1) AS v, array_to_string(near, chr(10)) AS near FROM l WHERE contains(t, '.call') AND NOT starts_with(trim(t), '//')),
  u AS (SELECT path, line FROM v WHERE CASE WHEN v <> '' THEN NOT regexp_matches(near, concat('require\\s*\\(\\s*', v, '\\b|if\\s*\\(\\s*!?\\s*', v, '\\b')) ELSE regexp_matches(t, '^\\s*[^=;]+\\.call\\s*[({{]') END),
  e AS (SELECT path, line, list_reduce(list_transform(nxt, lambda x, j: {{stop: false, hit: j::BIGINT, seen: x}}), lambda a, x: CASE WHEN a.stop THEN a WHEN contains(x.seen, '}}') AND NOT contains(x.seen, '{{') THEN {{stop: true, hit: 0::BIGINT, seen: ''}}
      WHEN trim(x.seen) <> '' AND NOT starts_with(trim(x.seen), '//') AND regexp_matches(x.seen, '{re2(fixed.STATE_WRITE)}') AND NOT contains(x.seen, '==') AND NOT regexp_matches(a.seen, '{re2(fixed.FAILED_GUARD)}') THEN {{stop: true, hit: x.hit, seen: ''}}
      ELSE {{stop: false, hit: 0::BIGINT, seen: concat(a.seen, chr(10), x.seen)}} END, {{stop: false, hit: 0::BIGINT, seen: t}}).hit AS n FROM l WHERE regexp_matches(t, '{re2(fixed.EXTERNAL_CALL)}')),
  o AS (SELECT path, 'weak_randomness' AS rule, a AS line, 'high' AS severity, -1 AS i FROM sp UNION ALL SELECT path, rule, line, severity, i FROM s WHERE NOT (i = {block} AND EXISTS (SELECT 1 FROM sp WHERE sp.path = s.path AND s.line BETWEEN a AND b))
    UNION ALL SELECT path, 'unchecked_call', line, 'high', 0 FROM u UNION ALL SELECT path, 'reentrancy_state_after_call', line + n, 'critical', 0 FROM e WHERE n > 0),
  g AS (SELECT path, rule, line, arg_min(severity, i) AS severity FROM o GROUP BY path, rule, line)
  SELECT path, rule, line::INT AS line, CASE WHEN regexp_matches(path, '{re2(fixed.CONTRACT_TEST_PATH)}') THEN CASE severity {ranks} END ELSE severity END AS severity FROM g"""


@query(contract_sql(CONTRACTS_SQL))
def file_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (d % len(items) + 1).cast("int"))
    path = F.replace(pick(CONTRACT_PATHS), F.lit("{}"), d.cast("string"))
    rows = table(spark, sf_dir, "documents").select(path.alias("path"), F.concat(pick(CONTRACT_BODIES), F.lit("\n// "), F.left("text", F.lit(40))).alias("body"))
    found = scan.contract_file_findings(rows, "path", "body")
    return found.select("path", "rule", F.col("line").cast("int").alias("line"), "severity")


#: Bodies of modules that import each other, with the number of the next one for the braces.
MODULES = [
    ("m{}.py", "import os\nfrom lib.m{} import x\nimport m{}.sub\nfrom _private import y\n"), ("lib/m{}.py", "import m{}\n\n  import json.decoder\n"), ("web/m{}.ts", "import a from './m{}'\nimport b from \"../lib/m{}.js\"\nconst c = require('react/dom')\n"),
    ("web/m{}.js", "const d = require( \"./../web/./m{}\" )\nfrom './'\n"), ("lib/m{}.js", "import z from '@scope/pkg'\nimport q from './../../../up/m{}'\n"), ("c/M{}.sol", "contract M{} { }"), ("notes/m{}.md", "import nothing\n"),
]
N = len(MODULES)
MODULES_SQL = f"(SELECT doc_id, concat('r', doc_id % 3) AS tree, replace(({[p for p, _ in MODULES]})[1 + doc_id % {N}], '{{}}', (doc_id // 7)::VARCHAR) AS path, replace(list_value({', '.join(map(_text_sql, (b for _, b in MODULES)))})[1 + doc_id % {N}], '{{}}', ((doc_id * 5) % 97 // 7)::VARCHAR) AS body FROM documents)"


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda i: F.element_at(F.array(*[F.lit(m[i]) for m in MODULES]), (d % N + 1).cast("int"))
    path = F.replace(pick(0), F.lit("{}"), F.floor(d / 7).cast("string"))
    body = F.replace(pick(1), F.lit("{}"), F.floor((d * 5) % 97 / 7).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("r"), (d % 3).cast("string")).alias("tree"), path.alias("path"), body.alias("body"))


NAMES_SQL = """(SELECT tree, path, n[1] AS a, n[2] AS b FROM (SELECT tree, path, unnest(list_zip(regexp_extract_all(body, '{p}', 1), regexp_extract_all(body, '{p}', 2))) AS n FROM {files} WHERE regexp_matches(path, '{ends}')))"""
PY_SQL = f"(SELECT tree, path, CASE WHEN a <> '' THEN a ELSE b END AS name FROM {NAMES_SQL.format(p=re2(fixed.PYTHON_IMPORT), files=MODULES_SQL, ends=chr(92) + '.py$')})"
JS_SQL = f"(SELECT tree, path, CASE WHEN a <> '' THEN a ELSE b END AS name FROM {NAMES_SQL.format(p=re2(fixed.SCRIPT_IMPORT), files=MODULES_SQL, ends=chr(92) + '.(ts|tsx|js|jsx|mjs|cjs)$')})"
#: A path without steps that cancel, from the parts of its folder and its name.
NORMAL_SQL = "(CASE WHEN np = '' THEN '.' ELSE np END)"
STEPS_SQL = """list_reduce(list_transform(string_split(concat(regexp_extract(path, '^(.*)/[^/]*$', 1), '/', name), '/'), lambda s: [s]), lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[:-2] ELSE list_append(a, x[1]) END, []::VARCHAR[])"""
JS_BASE_SQL = f"(SELECT tree, path, name, {NORMAL_SQL} AS base FROM (SELECT tree, path, name, array_to_string({STEPS_SQL}, '/') AS np FROM {JS_SQL} WHERE starts_with(name, '.')))"


@query(f"""SELECT src, dst, kind, count(*)::BIGINT AS n FROM (SELECT path AS src, concat('py:', split_part(name, '.', 1)) AS dst, 'imports' AS kind FROM {PY_SQL} WHERE split_part(name, '.', 1) <> '' AND NOT starts_with(name, '_')
  UNION ALL SELECT path, concat('pkg:', split_part(name, '/', 1)), 'imports' FROM {JS_SQL} WHERE NOT starts_with(name, '.') UNION ALL SELECT path, base, 'imports' FROM {JS_BASE_SQL} UNION ALL SELECT path, 'solidity', 'defines' FROM {MODULES_SQL} WHERE ends_with(path, '.sol')) GROUP BY ALL""")
def imp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.edges(_modules(spark, sf_dir)).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


TRIES_SQL = f"(SELECT unnest({list(fixed.SCRIPT_TRIES)}) AS e, unnest(range({len(fixed.SCRIPT_TRIES)})) AS i)"


@query(f"""WITH f AS (SELECT DISTINCT tree, path FROM {MODULES_SQL}), m AS (SELECT tree, regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '\\.__init__$', '') AS name, max(path) AS dst FROM f WHERE ends_with(path, '.py') GROUP BY 1, 2),
  p AS (SELECT n.tree, n.path AS src, coalesce(a.dst, b.dst) AS dst FROM {PY_SQL} n LEFT JOIN m a ON a.tree = n.tree AND a.name = n.name LEFT JOIN m b ON b.tree = n.tree AND b.name = split_part(n.name, '.', 1) WHERE n.name <> '' AND NOT starts_with(n.name, '_')),
  s AS (SELECT j.tree, j.path AS src, arg_min(f.path, i) AS dst FROM {JS_BASE_SQL} j, {TRIES_SQL} t JOIN f ON f.path = concat(j.base, t.e) AND f.tree = j.tree WHERE regexp_matches(f.path, '\\.(ts|tsx|js|jsx|mjs|cjs)$') AND f.path <> j.path GROUP BY j.tree, j.path, j.base)
  SELECT DISTINCT tree, src, dst FROM (SELECT * FROM p UNION ALL SELECT * FROM s) WHERE dst IS NOT NULL AND dst <> src""")
def imp_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.file_edges(_modules(spark, sf_dir), tree="tree")


@query(f"""SELECT tree, module, n FROM (SELECT tree, split_part(name, '.', 1) AS module, count(*)::BIGINT AS n FROM {PY_SQL} WHERE name <> '' AND NOT starts_with(name, '_') GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY n DESC, module) <= 10""")
def imp_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten Python packages that most lines of a tree import."""
    rows = _modules(spark, sf_dir).filter(F.endswith("path", F.lit(".py"))).select("tree", F.explode(imports.python_names(F.col("body"))).alias("name")).filter((F.col("name") != "") & ~F.startswith("name", F.lit("_")))
    return tree.most(rows.groupBy("tree", F.split("name", r"\.")[0].alias("module")).agg(F.count("*").alias("n")), ["tree"], [F.desc("n"), F.col("module")], 10).drop("place")


@query()
def imp_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one tree; Python's imports are parsed, so SQL cannot state them."""
    return imports.capture(_modules(spark, sf_dir).filter("tree = 'r0'"))
