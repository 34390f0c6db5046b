"""Column functions on text: counts, masks, hashes, classes. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import fixed

#: Where Python's splitlines() breaks a text.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.EMAIL), F.lit(0))))


def lines(text: Column) -> Column:
    """Lines of a text; a final break opens no further line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def newline_lines(text: Column) -> Column:
    """Lines of a text that end in nothing but a newline; a final one opens no further line, and an empty text is one line."""
    parts = F.split(text, "\n")
    return F.when(F.endswith(text, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trim_spaces(text: Column) -> Column:
    """A text without the spaces, of any width and script, at its ends."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def loc(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda x: x != "")).cast("long")


def mask(token: Column) -> Column:
    t = F.trim(token)
    short = F.concat(F.left(t, F.lit(3)), F.lit("***"))
    return F.when(F.length(t) <= 12, short).otherwise(F.concat(F.left(t, F.lit(6)), F.lit("…"), F.right(t, F.lit(4)), F.lit(" ("), F.length(t).cast("string"), F.lit(" chars)")))


def severity(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 30, "medium").otherwise("low")


def severity_node(score: Column) -> Column:
    """The other scale: the same scores read against 9, 7 and 5."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 5, "medium").otherwise("low")


def severity_rank(name: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in fixed.SEVERITIES]), name), F.lit(9)).cast("int")


def receipt(rule: Column, path: Column, line: Column, snippet_sha256: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.left(F.sha2(F.concat_ws("|", rule, path, line.cast("string"), snippet_sha256), 256), F.lit(16)))


def truncate(text: Column, size: int, mark: str = "\n… (truncated)") -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size - 20)), F.lit(mark))).otherwise(text)


def short_url(url: Column, size: int = 64) -> Column:
    bare = F.regexp_replace(url, "^https?://", "")
    return F.when(F.length(bare) <= size, bare).otherwise(F.concat(F.left(bare, F.lit(size - 1)), F.lit("…")))


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def visible(text: Column) -> Column:
    """Text without invisible and formatting characters."""
    return F.regexp_replace(text, r"\p{Cf}", "")


def is_private(text: Column) -> Column:
    return text.rlike(fixed.PRIVATE) | text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def spdx(text: Column) -> Column:
    out = F.lit("unknown")
    for pattern, name in reversed(fixed.LICENSES):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def terms(text: Column) -> Column:
    """Distinct terms of three letters or more, without stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in fixed.STOPWORDS]))


def pick(seed: Column, options: int) -> Column:
    """Which of several options a text gets: the first byte of its digest, modulo their number."""
    return F.conv(F.left(F.sha2(F.lower(F.trim(seed)), 256), F.lit(2)), 16, 10).cast("int") % options


def xml_escape(text: Column) -> Column:
    legal = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", "\ufffd")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        legal = F.replace(legal, F.lit(a), F.lit(b))
    return legal
