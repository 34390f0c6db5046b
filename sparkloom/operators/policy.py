"""Rules of access and talk: robots, llms.txt, sitemaps, commands, intents, answers, chat access. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import fixed, text


def robots_rules(robots: DataFrame) -> DataFrame:
    """(origin, kind, value) from (origin, body): allow, disallow and crawl-delay of the ``*`` group, sitemaps and signals of any.

    Each user-agent line replaces the group; comments end a line; empty rules are dropped.
    """
    rows = robots.select("origin", F.posexplode(F.split("body", "\r?\n")).alias("at", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", "")))
    rows = rows.filter(F.contains("raw", F.lit(":"))).select("origin", "at", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("key"), F.trim(F.regexp_replace("raw", "^[^:]*:", "")).alias("value"))
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("origin").orderBy("at"))
    rows = rows.withColumn("agent", agent)
    own = F.col("key").isin("allow", "disallow", "crawl-delay") & (F.col("agent") == "*")
    return rows.filter((own | F.col("key").isin("sitemap", "content-signal")) & (F.col("value") != "")).select("origin", "at", F.col("key").alias("kind"), "value")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(origin, path, allowed): an allow wins only if it is strictly longer than the longest disallow."""
    fit = urls.join(rules.filter(F.col("kind").isin("allow", "disallow")), "origin", "left").withColumn("n", F.when(F.col("path").startswith(F.col("value")), F.length("value")))
    best = fit.groupBy("origin", "path").agg(F.max(F.when(F.col("kind") == "allow", F.col("n"))).alias("a"), F.max(F.when(F.col("kind") == "disallow", F.col("n"))).alias("d"))
    return best.select("origin", "path", (F.col("d").isNull() | (F.coalesce("a", F.lit(-1)) > F.col("d"))).alias("allowed"))


def signals(value: Column) -> Column:
    """Array of (key, value) from a comma-separated list of ``key=value``."""
    return F.filter(F.transform(F.split(F.lower(value), ","), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("value"), F.contains(p, F.lit("=")).alias("ok"))), lambda s: s["ok"])


def llms_links(files: DataFrame) -> DataFrame:
    """(origin, section, at, name, url, note) from (origin, body); links before any section are in ``intro``."""
    rows = files.select("origin", F.posexplode(F.split("body", "\n")).alias("at", "raw"))
    section = F.last(F.when(F.col("raw").startswith("## "), F.trim(F.substr("raw", F.lit(4)))), ignorenulls=True).over(Window.partitionBy("origin").orderBy("at"))
    link = fixed.LISTED_LINK
    rows = rows.withColumn("section", F.coalesce(section, F.lit("intro"))).filter(F.col("raw").rlike(link))
    return rows.select("origin", "section", "at", F.regexp_extract("raw", link, 1).alias("name"), F.regexp_extract("raw", link, 2).alias("url"), F.trim(F.regexp_extract("raw", link, 3)).alias("note"))


def sitemap_locations(xml: Column, most: int = 300) -> Column:
    """Locations of a sitemap or index; none from one that declares entities."""
    found = F.regexp_extract_all(xml, F.lit(fixed.MAP_LOCATION), F.lit(1))
    kept = F.filter(F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: u.rlike("^https?://") & (F.length(u) <= 2048))
    return F.when(xml.rlike(fixed.DECLARES_ENTITIES), F.array().cast("array<string>")).otherwise(F.slice(kept, 1, most))


def intent(body: Column, name: str = "this bot") -> Column:
    """The first intent one of whose words is a part of the text; parts of words count.

    ``name`` is what the one who is talked to is called: asking what it is asks for its identity.
    """
    t = F.regexp_replace(F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(body, F.lit("")))), F.lit(" ")), r"\s+", " ")
    out = F.when(F.trim(t) == "", "unknown")
    for kind, words in fixed.INTENTS:
        own = [f"what is {name.lower()}"] if kind == "identity" else []
        out = out.when(text.contains_any(t, [*words, *own]), kind)
    return out.when(F.rtrim(F.trim(t), F.lit("?! ")).isin(*fixed.GREETINGS), "greeting").when(text.contains_any(t, fixed.QUESTIONS), "code_q").otherwise("banter")


def guarded(answer: Column) -> Column:
    """An answer that may be said, cut at its last sentence if it is long; else empty."""
    t = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")
    rows = F.transform(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S")), lambda x: F.regexp_replace(x, r"\s+$", ""))
    whole = F.array_join(rows, "\n")
    head = F.left(whole, F.lit(fixed.ANSWER_CHARS))
    # The end of the last sentence: what stands before the last mark that a blank follows.
    sentences = F.regexp_extract(head, r"(?s)^(.*[.!?]) ", 1)
    cut = F.when(F.length(sentences) > 41, sentences).otherwise(F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("…")))
    return F.when((t == "") | text.contains_any(F.lower(t), fixed.FORBIDDEN) | (F.size(rows) > fixed.ANSWER_LINES), "").when(F.length(whole) > fixed.ANSWER_CHARS, cut).otherwise(whole)


def command(body: Column, most: int = 4000) -> Column:
    """(kind, arg, depth, error) of a slash command; ``reject`` with the first reason that applies."""
    s = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    name = F.substring_index(F.regexp_extract(s, r"^(\S+)", 1), "@", 1)
    rest = F.regexp_extract(s, r"(?s)^\S+\s+(.*)$", 1)
    kind = F.substr(name, F.lit(2))
    words = F.filter(F.split(rest, r"\s+"), lambda x: x != "")
    n = F.size(words)
    depth = F.try_element_at(words, F.lit(2)).try_cast("int")
    url, objective = F.trim(F.substring_index(rest, "|", 1)), F.trim(F.regexp_extract(rest, r"(?s)^[^|]*\|(.*)$", 1))
    public = url.rlike(r"^https?://[^/?#@\s:]+(/[^?#\s]*)?$") & (F.length(url) <= 2048)

    def out(k: Column | str, arg: Column | None = None, d: Column | None = None, error: Column | str | None = None) -> Column:
        literal = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(literal(k).alias("kind"), literal(arg).cast("string").alias("arg"), literal(d).cast("int").alias("depth"), literal(error).cast("string").alias("error"))

    def no(error: Column | str) -> Column:
        return out("reject", error=error)

    payload = F.when((n >= 1) & (F.length(words[0]) <= 64) & words[0].rlike(r"(?U)^[\w-]+$"), F.try_element_at(words, F.lit(1)))
    usage = F.concat(F.lit("usage: /"), kind, F.lit(" <url>"))
    return (
        F.when(F.coalesce(body, F.lit("")) == "", no("empty message"))
        .when(F.length(body) > most, no("message too long"))
        .when(~s.startswith("/"), no("not a command"))
        .when(~name.isin(*fixed.COMMANDS), no("unknown command"))
        .when((kind == "judge") & (~public | (objective == "") | (F.octet_length(objective) > 1024) | text.is_private(objective)), no("usage: /judge <public-url> | <objective>"))
        .when(kind == "judge", out("judge", url))
        .when(kind == "start", out("start", F.when(n >= 1, payload)))
        .when(kind.isin(*fixed.BARE), out(kind))
        .when(kind.isin(*fixed.ONE_URL) & (n != 1), no(usage))
        .when(kind.isin(*fixed.ONE_URL), out(kind, rest))
        .when((kind == "sigil") & (rest == ""), no("usage: /sigil <words>"))
        .when((kind == "sigil") & (F.length(rest) > 200), no("sigil too long (max 200)"))
        .when(kind == "sigil", out("sigil", rest))
        .when((n == 0) | (n > 2), no("usage: /crawl <url> [depth 1-4]"))
        .when((n == 2) & depth.isNull(), no("usage: /crawl <url> [depth 1-4]"))
        .when((n == 2) & ~depth.between(1, 4), no("usage: depth must be 1-4"))
        .otherwise(out("crawl", F.try_element_at(words, F.lit(1)), F.when(n == 2, depth)))
    )


def access(chat_type: Column, user_known: Column, group_known: Column, is_bot: Column, open_dms: bool = False) -> Column:
    """Reason of a chat decision; those that begin with dm or group- and plain group let the message in."""
    return (
        F.when(chat_type == "private", F.when(F.lit(open_dms), "dm-open").when(user_known, "dm").otherwise("sender not allowlisted"))
        .when(chat_type.isin("group", "supergroup"), F.when(~group_known, "group not allowlisted").when(is_bot, "group-bot").otherwise("group"))
        .otherwise(F.concat(F.lit("chat type not allowed: "), F.coalesce(chat_type, F.lit("None"))))
    )
