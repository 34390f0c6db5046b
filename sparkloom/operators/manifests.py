"""Dependencies that manifests declare: (path, eco, name, version), at most 25 of each manifest, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import fixed, text

def dependencies(manifests: DataFrame) -> DataFrame:
    """From (path, eco, body). Lines are matched by the parser of the ecosystem; TOML and YAML ones inside their sections."""
    parser = F.lit(None).cast("string")
    for eco, name in fixed.PARSERS.items():
        parser = F.when(F.col("eco") == eco, name).otherwise(parser)
    rows = manifests.withColumn("parser", parser).filter("parser is not null")

    lines = rows.filter(F.col("parser").isin(*fixed.DEP_LINES)).select("path", "eco", "parser", F.posexplode(text.lines(F.col("body"))).alias("at", "raw"))
    lines = lines.withColumn("raw", F.when((F.col("parser") == "go") & F.trim("raw").startswith("require"), F.trim(F.regexp_replace(F.trim("raw"), "^[require]+", ""))).otherwise(F.col("raw")))
    w = Window.partitionBy("path").orderBy("at")
    table = F.when((F.col("parser") == "cargo") & F.trim("raw").rlike(r"^\[.*\]$"), F.lower(F.regexp_replace(F.trim("raw"), r"[\[\] ]", "")))
    block = F.when((F.col("parser") == "pub") & F.col("raw").rlike("^[a-zA-Z_]+:"), F.regexp_extract("raw", "^([a-zA-Z_]+):", 1))
    lines = lines.withColumn("section", F.last(F.coalesce(table, block), ignorenulls=True).over(w))
    wanted = F.when(F.col("parser") == "cargo", F.col("section").isin("dependencies", "dev-dependencies", "build-dependencies") & ~F.trim("raw").startswith("#")).when(
        F.col("parser") == "pub", F.col("section").isin("dependencies", "dev_dependencies")
    ).otherwise(True)
    name, version = F.lit(""), F.lit("")
    for key, pattern in fixed.DEP_LINES.items():
        found = [F.regexp_extract("raw", pattern, i) for i in range(1, 4 if key == "cargo" else 3)]
        own = F.when(found[1] != "", found[1]).otherwise(found[2]) if key == "cargo" else found[1]
        name, version = F.when(F.col("parser") == key, found[0]).otherwise(name), F.when(F.col("parser") == key, own).otherwise(version)
    lines = lines.filter(F.coalesce(wanted, F.lit(False))).withColumn("name", name).withColumn("version", F.when(version == "", "*").otherwise(version)).filter("name <> ''")
    lines = lines.filter((F.col("parser") != "toml") | ~F.col("name").isin(*fixed.TOML_OWN)).select("path", "eco", "at", "name", "version")

    made = [lines]
    for parser_name, sections in fixed.JSON_SECTIONS.items():
        own = rows.filter(F.col("parser") == parser_name)
        schema = ", ".join(f"`{s}` map<string,string>" for s in sections)
        parsed = own.withColumn("j", F.from_json("body", schema))
        for i, s in enumerate(sections):
            one = parsed.select("path", "eco", F.posexplode(F.map_entries(F.col(f"j.`{s}`"))).alias("at", "e"))
            made.append(one.select("path", "eco", (F.col("at") + i * 1_000_000).alias("at"), F.col("e.key").alias("name"), F.col("e.value").alias("version")).filter((F.col("name") != "php") | F.lit(parser_name != "composer")))
    pom = rows.filter("parser = 'pom'").select("path", "eco", F.regexp_extract_all("body", F.lit(fixed.POM_NAME), F.lit(1)).alias("a"), F.regexp_extract_all("body", F.lit(fixed.POM_VERSION), F.lit(1)).alias("v"))
    made.append(pom.select("path", "eco", F.posexplode("a").alias("at", "name"), "v").select("path", "eco", "at", "name", F.coalesce(F.get("v", F.col("at")), F.lit("*")).alias("version")))
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    first = F.row_number().over(Window.partitionBy("path").orderBy("at", "name"))
    return every.withColumn("nth", first).filter(F.col("nth") <= fixed.DEPS_EACH).select("path", "eco", "name", "version")


def sbom(deps: DataFrame, most: int = 400) -> DataFrame:
    return deps.select("eco", "name", "version").distinct().orderBy("eco", "name", "version").limit(most)


def unpinned(lines: DataFrame) -> DataFrame:
    """(path, line, text) of package.json entries without a version and requirements without ``==``."""
    name, t = F.regexp_extract("path", r"([^/]*)$", 1), F.trim("text")
    npm = (name == "package.json") & t.rlike(r'^"[^"]+"\s*:\s*"(\*|latest|)"')
    pip = name.rlike(r"^requirements.*\.txt$") & (t != "") & ~t.rlike("^[#-]") & ~F.contains(t, F.lit("=="))
    return lines.filter(npm | pip)
