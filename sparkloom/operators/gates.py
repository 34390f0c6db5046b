"""Gates: crawl access by two origins, what a site publishes, evidence spans of a page, budgets of renders and decisions, outcomes.

All results are columns or tables; nulls count as missing and never let anything through.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import fixed, text
from sparkloom.functions import url as urls
from sparkloom.operators import html, intake, policy, state

MOST_SPANS, SPAN_BYTES, LONG_SPAN = 12, 512, 64


def site_reason(origin: Column, target: Column) -> Column:
    """Why a url is not of the site that a crawl began on: another host, no longer https, another port, or a user in it; else empty."""
    return (
        F.when(~urls.scheme(target).isin("http", "https") | (urls.host(target) == ""), "scheme").when(F.contains(urls.netloc(target), F.lit("@")), "user").when(urls.site_key(origin) != urls.site_key(target), "host")
        .when((urls.scheme(origin) == "https") & (urls.scheme(target) != "https"), "downgrade").when((urls.port(target) != "") & (urls.effective_port(target) != F.when(urls.scheme(target) == "https", "443").otherwise("80")), "port").otherwise("")
    )


def access(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, allowed) of (id, origin, url): rules (origin, kind, value) of the start's and of the url's own origin must allow every form of its path.

    An origin without rules allows all; an ambiguous or over-encoded path is denied.
    """
    forms = intake.crawl_paths(F.nullif(urls.part(F.col("url"), 3), F.lit("")))
    rows = targets.select("id", "origin", urls.origin(F.col("url")).alias("own"), site_reason(F.col("origin"), F.col("url")).alias("reason"), forms.alias("forms"))
    asked = rows.filter("reason = '' and forms is not null").select("id", F.explode(F.array_distinct(F.array("origin", "own"))).alias("origin"), "forms").select("id", "origin", F.explode("forms").alias("path"))
    told = policy.robots_allowed(asked.select("origin", "path").distinct(), rules)
    fine = asked.join(told, ["origin", "path"]).groupBy("id").agg(F.bool_and("allowed").alias("allowed"))
    return rows.select("id").join(fine, "id", "left").select("id", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def published(robots: DataFrame, llms: DataFrame) -> DataFrame:
    """(origin, robots_found, disallow, allow, sitemaps, llms_found, sections) from files (origin, body); a null body is no file."""
    rules = policy.robots_rules(robots.filter("body is not null"))
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    counted = rules.groupBy("origin").agg(of("disallow"), of("allow"), F.array_sort(F.collect_list(F.when(F.col("kind") == "sitemap", F.col("value")))).alias("sitemaps"))
    section = F.regexp_extract_all("body", F.lit(r"(?m)^## (.*)$"), F.lit(1))
    named = llms.select("origin", F.col("body").isNotNull().alias("llms_found"), F.coalesce(F.transform(section, lambda s: F.trim(s)), F.array().cast("array<string>")).alias("sections"))
    found = robots.select("origin", F.col("body").isNotNull().alias("robots_found"))
    rows = found.join(named, "origin", "full_outer").join(counted, "origin", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<string>")
    no = F.lit(False)
    return rows.select("origin", F.coalesce("robots_found", no).alias("robots_found"), zero("disallow"), zero("allow"), F.coalesce("sitemaps", none).alias("sitemaps"), F.coalesce("llms_found", no).alias("llms_found"), F.coalesce("sections", none).alias("sections"))


def _cut_bytes(value: Column, most: int) -> Column:
    """The longest whole part of a text in at most ``most`` bytes of UTF-8."""
    raw = value.cast("binary")
    tries = [F.try_validate_utf8(F.substring(raw, 1, most - i).cast("string")) for i in range(4)]
    return F.when(F.octet_length(value) <= most, value).otherwise(F.coalesce(*tries))


def evidence_spans(df: DataFrame, key: str, objective: str, body: str = "html", ended: bool = False) -> DataFrame:
    """(key, place, id, excerpt, byte_offset): the page's visible texts that serve an objective best, at most twelve.

    Texts with most terms of the objective come first, then long ones, then by place; private texts and those whose cut
    is not literally in the page are left out. A text counts once. References are decoded as in ``html.tokens``.
    """
    own = text.terms(F.lit(objective))
    rows = html.pages(df.select(key, body), body, True, fields=("text_nodes",), ended=ended).select(key, body, F.posexplode("page.text_nodes").alias("i", "node"))
    rows = rows.withColumn("span", F.regexp_replace("node", r"(?U)^\s+|\s+$", "")).filter("span <> ''")
    shared = F.size(F.array_intersect(text.terms(F.col("span")), own))
    rows = rows.withColumn("rank", F.struct(-shared, -(F.length("span") >= LONG_SPAN).cast("int"), F.col("i")))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key, "span").orderBy("rank"))).filter("nth = 1").filter(~text.is_private(F.col("span")))
    cut = first.withColumn("excerpt", _cut_bytes(F.col("span"), SPAN_BYTES)).withColumn("at", F.instr(body, F.col("excerpt"))).filter("at > 0")
    offset = F.octet_length(F.left(body, F.col("at") - 1)).cast("long")
    placed = cut.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).filter(F.col("place") <= MOST_SPANS).withColumn("byte_offset", offset)
    name = F.concat(F.lit("span_"), F.left(F.sha2(F.concat_ws(":", F.sha2(body, 256), F.col("byte_offset").cast("string"), "excerpt"), 256), F.lit(16)))
    return placed.select(key, F.col("place").cast("long").alias("place"), name.alias("id"), "excerpt", "byte_offset")


def renders(df: DataFrame, needs: Column, order: list[str], most: int = 25) -> DataFrame:
    """``df`` with ``path``: http, rendered, or budget-exhausted; the first ``most`` that need it are rendered."""
    wanted = df.withColumn("needs", F.coalesce(needs, F.lit(False)))
    chosen = wanted.filter("needs").orderBy(*order).limit(most).select(*order).withColumn("in_budget", F.lit(True))
    met = wanted.join(F.broadcast(chosen), order, "left")
    return met.withColumn("path", F.when(~F.col("needs"), "http").when(F.col("in_budget"), "rendered").otherwise("budget-exhausted")).drop("needs", "in_budget")


def decisions(df: DataFrame, keys: list[str], order: list[str], size: str, used: str, budget: str, rate: str, attempts: int = 5) -> DataFrame:
    """``df`` with ``outcome`` of each request: ok, provider_error, or budget_exhausted.

    A request reserves its bytes at ``rate``, and is refused beyond the budget or after ``attempts``; one that succeeds
    (``used`` tokens) then pays for these instead, one that fails (null) closes the run and keeps its reservation.
    """
    price, most = Decimal(rate), Decimal(budget)

    def step(run: list, row: tuple) -> str:
        closed, n, spent = run
        reserved = Decimal(row[0] or 0) * price
        if closed or n >= attempts or spent + reserved > most:
            return "budget_exhausted"
        if row[1] is None:
            run[:] = True, n + 1, spent + reserved
            return "provider_error"
        run[:] = False, n + 1, spent + Decimal(row[1]) * price
        return "ok"

    return state.folded(df, keys, order, [size, used], lambda: [False, 0, Decimal(0)], step, "outcome string")


def active_tokens(df: DataFrame, consumed: Column, expires: Column, now: Column) -> DataFrame:
    return df.agg(F.count_if(consumed.isNull() & (expires > now)).alias("active"))


def judged(df: DataFrame, outcome: Column, first: Column, second: Column) -> DataFrame:
    """(evaluated, unexecuted, abstained, same, different, open) of outcomes and of the choices under two orders of the options."""
    valid, both = outcome.isin("ok", "abstained"), (F.coalesce(first, F.lit("")) != "") & (F.coalesce(second, F.lit("")) != "")
    return df.agg(
        F.count_if(valid).alias("evaluated"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("unexecuted"), F.count_if(outcome == "abstained").alias("abstained"),
        F.count_if(both & (first == second)).alias("same"), F.count_if(both & (first != second)).alias("different"), F.count_if(~both).alias("open"),
    )


def judge_exit(outcome: Column, offline: Column) -> Column:
    return F.when(outcome == "denied", 2).when(outcome.isin("ok", "abstained") | (offline & (outcome == "unavailable")), 0).otherwise(1)


def upload_outcome(chat: Column, enabled: Column, reason: Column, located: Column, path: Column, status: Column, size: Column, cap: Column, archive: Column, opened: Column, sealed: Column) -> Column:
    """What an upload leads to, by the first check that fails; ``reason`` is that of its name and size."""
    ladder = [
        (chat != "private", "upload-not-dm"), (~enabled, "upload-disabled"), (reason != "", "upload-refused"), (~located, "upload-getfile"), (~intake.is_server_path(path), "upload-badpath"), (status.isNull(), "upload-fetch"),
        ((status != 200) | (size == 0), "upload-empty"), (size > cap, "upload-toobig"), (~archive, "upload-notarchive"), (~opened, "upload-unopenable"), (sealed, "upload:sealed"),
    ]
    return _first(ladder, "upload")


def bundle_outcome(chat: Column, has_key: Column, refused: Column, failed: Column, sent: Column, files: Column) -> Column:
    ladder = [(chat != "private", "bundle-dm-only"), (~has_key, "bundle-no-key"), (refused, "bundle-refused"), (failed, "bundle-error"), (~sent, "bundle-upload-error")]
    return _first(ladder, F.concat(F.lit("bundle:"), files.cast("string"), F.lit("f")))


def _first(ladder: list[tuple[Column, str]], rest: Column | str) -> Column:
    out = rest if isinstance(rest, Column) else F.lit(rest)
    for when, what in reversed(ladder):
        out = F.when(F.coalesce(when, F.lit(True)), what).otherwise(out)
    return out


def handled(kind: Column, failure: Column, key: Column) -> Column:
    """The log entry of a command: denied if its refusal is typed, error for anything else, and its key if it went well."""
    return F.when(failure == "refused", F.concat(kind, F.lit("-denied"))).when(failure.isNotNull(), F.concat(kind, F.lit("-error"))).otherwise(F.concat(kind, F.lit(":"), key))


def question_reason(questions: object) -> str:
    """What is wrong with a set of questions; empty if nothing is."""
    if not isinstance(questions, dict) or not questions:
        return "questions"
    for name, q in questions.items():
        if not isinstance(name, str) or not name or not isinstance(q, dict):
            return "questions"
        kind, criteria = q.get("type"), q.get("criteria")
        if kind not in fixed.QUESTION_TYPES:
            return "question_type"
        named = isinstance(criteria, dict) and len(criteria) >= 2 and all(isinstance(k, str) and k for k in criteria)
        listed = isinstance(criteria, list) and len(criteria) >= 2
        if (kind == "choice" and not named) or (kind == "score" and not listed):
            return "criteria"
    return ""
