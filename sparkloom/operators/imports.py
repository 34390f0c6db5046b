"""What source files import: by expression, by Python's own grammar, and as links between files of one tree.

Rows are (path, body) of one tree, paths relative with slashes, or of many if ``tree`` names a column. Null bodies import
nothing; repeated files give repeated rows where links are not made distinct.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import fixed


def _either(body: Column, pattern: str) -> Column:
    """The first of an expression's two groups that each match has."""
    one, two = (F.regexp_extract_all(body, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b))


def python_names(body: Column) -> Column:
    return _either(body, fixed.PYTHON_IMPORT)


def script_names(body: Column) -> Column:
    return _either(body, fixed.SCRIPT_IMPORT)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normal_path(path: Column) -> Column:
    """A relative path without empty, ``.`` and inner ``..`` steps; ``.`` if nothing is left."""
    none = F.array().cast("array<string>")

    def step(out: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(out) > 0) & F.coalesce(F.element_at(out, -1) != "..", F.lit(False))
        return F.when(part.isin("", "."), out).when(back, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.array_append(out, part))

    found = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    return F.when(found == "", F.lit(".")).otherwise(found)


def _joined(path: Column, name: Column) -> Column:
    inside = folder(path)
    return normal_path(F.when((inside == "") | F.startswith(name, F.lit("/")), name).otherwise(F.concat(inside, F.lit("/"), name)))


def _ends(path: Column, names: tuple[str, ...]) -> Column:
    return path.rlike(rf"\.({'|'.join(names)})$")


def edges(df: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(src, dst, kind): packages and relative paths that files import, and contracts that they define. Repeats stay."""
    p, b = F.col(path), F.col(body)
    first = lambda x, mark: F.split(x, mark)[0]
    packages = F.transform(F.filter(F.transform(python_names(b), lambda x: first(x, r"\.")), lambda x: (x != "") & ~F.startswith(x, F.lit("_"))), lambda x: F.concat(F.lit("py:"), x))
    scripts = F.transform(F.filter(script_names(b), lambda x: x != ""), lambda x: F.when(F.startswith(x, F.lit(".")), _joined(p, x)).otherwise(F.concat(F.lit("pkg:"), first(x, "/"))))
    targets = F.when(_ends(p, ("py",)), packages).when(_ends(p, fixed.SCRIPT_ENDS), scripts).when(_ends(p, ("sol",)) & b.rlike(r"contract\s+\w+"), F.array(F.lit("solidity")))
    kind = F.when(_ends(p, ("sol",)), "defines").otherwise("imports")
    return df.select(p.alias("src"), F.explode(targets).alias("dst"), kind.alias("kind"))


def file_edges(df: DataFrame, path: str = "path", body: str = "body", tree: str | None = None) -> DataFrame:
    """(tree, src, dst): files that import each other, each link once.

    A Python name is a module's dotted path, or else its first part; a relative script path is the first of the usual
    endings that there is. A file does not import itself.
    """
    t = F.lit("") if tree is None else F.col(tree).cast("string")
    rows = df.select(t.alias("tree"), F.col(path).alias("path"), F.col(body).alias("body"))
    python, scripts = rows.filter(_ends(F.col("path"), ("py",))), rows.filter(_ends(F.col("path"), fixed.SCRIPT_ENDS))
    dotted = F.regexp_replace(F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")
    modules = python.groupBy("tree", dotted.alias("name")).agg(F.max("path").alias("dst"))
    named = python.select("tree", F.col("path").alias("src"), F.explode(python_names(F.col("body"))).alias("full")).filter((F.col("full") != "") & ~F.startswith("full", F.lit("_"))).distinct()
    whole = named.join(modules.withColumnRenamed("name", "full"), ["tree", "full"], "left")
    part = whole.withColumn("name", F.split("full", r"\.")[0]).join(modules.withColumnRenamed("dst", "other"), ["tree", "name"], "left")
    of_python = part.select("tree", "src", F.coalesce("dst", "other").alias("dst"))
    base = scripts.select("tree", F.col("path").alias("src"), F.explode(script_names(F.col("body"))).alias("name")).filter(F.startswith("name", F.lit("."))).withColumn("base", _joined(F.col("src"), F.col("name"))).select("tree", "src", "base").distinct()
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(fixed.SCRIPT_TRIES)])
    tried = base.select("tree", "src", "base", F.explode(ends).alias("try")).withColumn("dst", F.concat("base", "try.e"))
    there = tried.join(scripts.select("tree", F.col("path").alias("dst")).distinct(), ["tree", "dst"], "left_semi").filter("dst <> src")
    of_scripts = there.groupBy("tree", "src", "base").agg(F.min_by("dst", "try.i").alias("dst")).select("tree", "src", "dst")
    return of_python.unionByName(of_scripts).filter("dst is not null and dst <> src").distinct()


def parsed_imports(path: str, body: str) -> list[str]:
    """Modules a Python file imports by its grammar, relative ones resolved; none if it cannot be parsed."""
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    parts = path.removesuffix(".py").split("/")
    package = parts if parts[-1] == "__init__" else parts[:-1]
    found: set[str] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and not node.level:
            found |= {node.module} if node.module else set()
        elif isinstance(node, ast.ImportFrom) and node.level <= len(package):
            own = package[: len(package) - node.level + 1]
            target = ".".join([*own, *([node.module] if node.module else [])])
            found |= {target} if target else {a.name for a in node.names if a.name != "*"}
    return sorted(found)


def capture(df: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(kind, key, hash) facts of a tree: modules, imports, entry points and declared dependencies, as drift compares them."""

    @F.pandas_udf("array<string>")
    def names(paths: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([parsed_imports(p, b) if b else [] for p, b in zip(paths, bodies, strict=True)])

    p, b = F.col("path"), F.col("body")
    rows = df.select(F.col(path).alias("path"), F.col(body).alias("body")).filter("path is not null and body is not null")
    null = F.lit(None).cast("string")
    modules = rows.select(F.lit("modules").alias("kind"), p.alias("key"), F.sha2(b, 256).alias("hash"))
    python = rows.filter(_ends(p, ("py",))).select(p, F.explode(names(p, b)).alias("dst"))
    live = F.array_join(F.filter(F.split(b, "\n"), lambda x: ~F.trim(x).rlike(r"^(//|\*|/\*)")), "\n")
    scripts = rows.filter(_ends(p, fixed.SCRIPT_ENDS)).select(p, F.explode(script_names(live)).alias("dst"))
    imports = python.union(scripts).distinct().select(F.lit("imports").alias("kind"), F.concat("path", F.lit(" -> "), "dst").alias("key"), null.alias("hash"))
    guards = rows.filter((_ends(p, ("py",)) & b.rlike(fixed.MAIN_GUARD)) | p.isin("main.py", "__main__.py")).select(F.lit("entrypoints").alias("kind"), p.alias("key"), null.alias("hash"))
    name = F.regexp_extract_all(F.array_join(F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: ~x.rlike("^[#-]")), "\n"), F.lit(r"(?m)^([A-Za-z0-9][A-Za-z0-9._-]*)"), F.lit(1))
    required = rows.filter(p.rlike(r"(^|/)requirements\.txt$")).select(F.explode(F.transform(name, lambda x: F.replace(F.lower(x), F.lit("_"), F.lit("-")))).alias("key"))
    sections = F.from_json(b, ", ".join(f"{s} map<string,string>" for s in fixed.PACKAGE_SECTIONS))
    packaged = rows.filter(p.rlike(r"(^|/)package\.json$")).select(F.explode(F.flatten(F.array(*[F.coalesce(F.map_keys(sections[s]), F.array().cast("array<string>")) for s in fixed.PACKAGE_SECTIONS]))).alias("key"))
    deps = required.union(packaged).distinct().select(F.lit("external_deps").alias("kind"), "key", null.alias("hash"))
    return modules.unionByName(imports).unionByName(guards).unionByName(deps)
