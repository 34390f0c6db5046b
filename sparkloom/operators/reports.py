"""Reports as text: audits and crawls in Markdown, drift as a map, events as lines, replies, and what an update leads to.

A report is one row of text for each tree or site; its tables are cut at fixed lengths, so a row stays small whatever was
found. Names that a report shows are parameters.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import fixed, text
from sparkloom.operators import tree

TABLE_ROWS, LANGUAGES, HOSTILE, FLAGS = 60, 12, 15, 4
#: The grid of a drift map: columns, where it begins, and its steps.
COLUMNS, LEFT, TOP, STEP_X, STEP_Y = 24, 24, 130, 44, 32


def gate(critical: Column, high: Column, medium: Column) -> Column:
    return F.when(critical > 0, "BLOCK").when(high + medium > 0, "REVIEW").otherwise("PASS")


def severity_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES])


def medium_by_rule(findings: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule, n, example): medium findings of each rule, with the first place."""
    rows = findings.filter("severity = 'medium'").groupBy(*by, "rule").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("first"))
    return rows.select(*by, "rule", "n", F.concat_ws(":", "first.path", F.col("first.line").cast("string")).alias("example"))


def _lines(rows: DataFrame, by: str, order: list[Column], line: Column, most: int, name: str) -> DataFrame:
    """(by, name): the first ``most`` lines of each group, in order, as one text."""
    placed = tree.most(rows.select("*", line.alias("line_text")), [by], order, most)
    return placed.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line_text"))), lambda x: x["line_text"]), "\n").alias(name))


def audit_markdown(findings: DataFrame, languages: DataFrame, by: str, title: str = "CODE AUDIT") -> DataFrame:
    """(by, report) from findings (by, rule, severity, path, line, detail) and languages (by, language, files)."""
    counts = severity_counts(findings, [by])
    worst = findings.filter(F.col("severity").isin("critical", "high"))
    row = F.concat(F.lit("| "), "severity", F.lit(" | "), "rule", F.lit(" | `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("` | "), F.coalesce("detail", F.lit("")), F.lit(" |"))
    table = _lines(worst, by, [tree.rank(F.col("severity")), F.col("path"), F.col("line"), F.col("rule")], row, TABLE_ROWS, "worst")
    kinds = medium_by_rule(findings, [by])
    kind = F.concat(F.lit("- **"), "rule", F.lit("** ×"), F.col("n").cast("string"), F.lit(" — e.g. `"), "example", F.lit("`"))
    medium = _lines(kinds, by, [F.desc("n"), F.col("rule")], kind, 1_000, "kinds")
    mix = _lines(languages, by, [F.desc("files"), F.col("language")], F.concat(F.lit("- `"), "language", F.lit("`: "), F.col("files").cast("string")), LANGUAGES, "mix")
    rows = functools.reduce(lambda a, b: a.join(b, by, "left"), [counts, table, medium, mix])
    number = lambda c: F.col(c).cast("string")
    verdict = F.concat(F.lit("- gate: **"), gate(F.col("critical"), F.col("high"), F.col("medium")), F.lit("**"))
    told = F.concat(F.lit("- findings: critical **"), number("critical"), F.lit("** · high **"), number("high"), F.lit("** · medium **"), number("medium"), F.lit("** · low **"), number("low"), F.lit("**"))
    part = lambda head, body: F.when(F.col(body).isNotNull(), F.concat(F.lit(f"\n## {head}\n"), body))
    head = F.when(F.col("worst").isNotNull(), F.concat(F.lit("\n## Critical / High\n| sev | kind | file:line | detail |\n|---|---|---|---|\n"), "worst"))
    return rows.select(by, F.concat_ws("\n", F.lit(f"# {title}"), F.lit("\n## Verdict"), verdict, told, part("Language mix", "mix"), head, part("Medium", "kinds")).alias("report"))


def crawl_markdown(pages: DataFrame, title: str = "SITE REPORT", most: int = 200) -> DataFrame:
    """One row (report) from pages (place, url, words, score, verdict, flags: array)."""
    rows = pages.withColumn("site", F.lit(1))
    shown = F.when(F.size("flags") > 0, F.array_join(F.array_sort(F.array_distinct("flags")), ",")).otherwise("—")
    line = F.concat(F.lit("| "), (F.col("place") + 1).cast("string"), F.lit(" | `"), text.short_url(F.col("url")), F.lit("` | "), F.col("words").cast("string"), F.lit(" | "), F.col("score").cast("string"), F.lit(" "), "verdict", F.lit(" | "), shown, F.lit(" |"))
    table = _lines(rows, "site", [F.col("place")], line, most, "table")
    bad = rows.filter("verdict <> 'TRUSTED'")
    told = F.concat(F.lit("- `"), text.short_url(F.col("url")), F.lit("` → **"), "verdict", F.lit("** ("), F.col("score").cast("string"), F.lit(")"), F.array_join(F.transform(F.slice("flags", 1, FLAGS), lambda f: F.concat(F.lit("\n  - "), f)), ""))
    hostile = _lines(bad, "site", [F.col("place")], told, HOSTILE, "hostile")
    counts = rows.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != "TRUSTED").alias("flagged"))
    whole = counts.join(table, "site").join(hostile, "site", "left")
    trust = F.concat(F.lit("- clean: "), (F.col("n") - F.col("flagged")).cast("string"), F.lit(" · flagged: **"), F.col("flagged").cast("string"), F.lit("**"))
    return whole.select(F.concat_ws("\n", F.lit(f"# {title}"), F.concat(F.lit("\n## Pages ("), F.col("n").cast("string"), F.lit(")\n| # | URL | words | trust | flags |\n|---|---|---|---|---|")), "table", F.lit("\n## Trust"), trust, "hostile").alias("report"))


def drift_cells(modules: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, kind, x, y) of a drift map: current modules (path) and removed ones, in order, on a grid. ``kind`` is null if unchanged."""
    changed = changes.filter(F.col("kind").isin("module_added", "module_modified", "module_removed")).select(F.col("target").alias("path"), "kind").distinct()
    rows = modules.select("path").union(changed.filter("kind = 'module_removed'").select("path")).distinct().join(changed, "path", "left")
    at = F.row_number().over(Window.orderBy("path")) - 1
    return rows.withColumn("at", at).select("path", "kind", (F.col("at") % COLUMNS * STEP_X + LEFT).cast("long").alias("x"), (F.floor(F.col("at") / COLUMNS) * STEP_Y + TOP).cast("long").alias("y"))


def drift_line(breaking: Column, notable: Column, info: Column) -> Column:
    total = breaking + notable + info
    return F.when(total == 0, "no drift (architecture unchanged)").otherwise(F.concat(total.cast("string"), F.lit(" drift: "), breaking.cast("string"), F.lit(" breaking, "), notable.cast("string"), F.lit(" notable, "), info.cast("string"), F.lit(" info")))


def drift_svg(cells: DataFrame, colors: dict[str, str], plain: str = "#101a33", edge: str = "#30d5ff") -> DataFrame:
    """One row (svg): the cells of a map as boxes with their paths as titles, and the paths below."""
    fill = functools.reduce(lambda out, c: F.when(F.col("kind") == c[0], c[1]).otherwise(out), colors.items(), F.lit(plain))
    box = F.concat(F.lit('<rect x="'), F.col("x").cast("string"), F.lit('" y="'), F.col("y").cast("string"), F.lit('" width="34" height="22" fill="'), fill, F.lit(f'" stroke="{edge}"><title>'), text.xml_escape(F.col("path")), F.lit("</title></rect>"))
    rows = cells.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", box.alias("box")))), lambda c: c["box"]), "\n").alias("boxes"), F.coalesce(F.max("y"), F.lit(TOP)).alias("bottom"))
    height = (F.col("bottom") + 2 * STEP_Y).cast("string")
    return rows.select(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="1100" height="'), height, F.lit('">\n'), "boxes", F.lit("\n</svg>")).alias("svg"))


def event_line(kind: Column, node: Column, payload: Column) -> Column:
    """One line for an event; the payload is a map of texts, lists in it joined with commas."""
    get = lambda key, other="": F.coalesce(F.try_element_at(payload, F.lit(key)), F.lit(other))
    seconds = F.format_string("%.2fs", get("duration", "0").cast("double"))
    lines = {
        "node_start": F.concat(F.lit("⟳ "), node, F.lit(" started")),
        "node_done": F.concat(F.lit("✓ "), node, F.lit(" done — "), get("findings", "0"), F.lit(" finding(s), "), get("files", "0"), F.lit(" file(s), "), seconds),
        "node_error": F.concat(F.lit("✗ "), node, F.lit(" failed — "), get("error")),
        "finding": F.concat(F.lit("⚑ "), get("severity", "?"), F.lit(" "), get("rule"), F.lit(" "), get("where")),
        "payment": F.concat(F.lit("💳 settled "), F.format_string("%.6f", get("amount_usdc", "0").cast("double")), F.lit(" USDC → "), get("payTo")),
        "swarm_start": F.concat(F.lit("🕸️ swarm starting — nodes: "), get("nodes")),
        "swarm_done": F.concat(F.lit("✓ swarm complete — "), get("findings", "0"), F.lit(" finding(s) in "), seconds),
    }
    other = F.coalesce(F.try_element_at(payload, F.lit("msg")), kind)
    return functools.reduce(lambda out, k: F.when(kind == k, lines[k]).otherwise(out), lines, other)


def replies(rows: DataFrame, intent: str, said: str, options: DataFrame) -> DataFrame:
    """``rows`` with ``reply``: of an intent's options (intent, i, text), counted from 0, the one that the text's digest picks."""
    sizes = options.groupBy(F.col("intent").alias("of")).agg(F.max(F.col("i") + 1).alias("n"))
    met = rows.join(F.broadcast(sizes), rows[intent] == sizes["of"], "left").drop("of")
    byte = F.conv(F.left(F.sha2(F.lower(F.trim(F.col(said))), 256), F.lit(2)), 16, 10).cast("int")
    met = met.withColumn("i", byte % F.col("n"))
    few = F.broadcast(options.select(F.col("intent").alias("of"), F.col("i").alias("nth"), F.col("text").alias("reply")))
    return met.join(few, (F.col(intent) == F.col("of")) & (F.col("i") == F.col("nth")), "left").drop("of", "nth", "i", "n")


def dispatched(ok: Column, reason: Column, chat: Column, addressed: Column, has_text: Column, has_file: Column, kind: Column, error: Column, throttled: Column, operator: Column) -> Column:
    """(action, detail) of an update: refused, ignored, handed on to a lane (social, upload, a command), or answered."""
    group = chat.isin("group", "supergroup")
    social = (kind == "reject") & error.isin("not a command", "empty message")
    action = (
        F.when(~ok, "denied").when(group & ~addressed, "ignored").when(~has_text & has_file, "upload").when(kind.isin(*fixed.EXPENSIVE) & throttled, "ignored").when(social, "social").when((kind == "judge") & ~operator, "denied")
    )
    action = action.when(kind == "reject", "replied").when(kind.isin("start", "help", "spellbook", "sigil", "lore", "judge"), "replied").otherwise("run")
    detail = (
        F.when(~ok, reason).when(group & ~addressed, "not addressed in group").when(~has_text & has_file, "document").when(kind.isin(*fixed.EXPENSIVE) & throttled, F.concat(F.lit("cooldown:"), kind)).when(social, error)
    )
    detail = detail.when((kind == "judge") & ~operator, "judge-operator-only").when(kind == "reject", F.concat(F.lit("reject:"), error)).otherwise(kind)
    return F.struct(action.alias("action"), detail.alias("detail"))
