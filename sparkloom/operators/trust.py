"""Trust in a page: hidden instructions, invisible characters, hidden elements, transport."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import fixed, needles, text

CORROBORATING = ("override", "role_hijack", "exfiltration", "rce_lure", "concealment", "tool_injection", "delimiter_spoof")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hit(seen: Column, low: Column, pattern: str) -> Column:
    """Whether a text has a match; tried only where it has a string that every match has."""
    return needles.likely(low, pattern) & seen.rlike(f"(?i){pattern}")


def hits(body: Column) -> Column:
    """For each pattern in its order, 1 if the visible text has a match and else 0."""
    flags = lambda seen, low: F.array(*[F.when(_hit(seen, low, p), 1).otherwise(0) for p, _ in fixed.INJECTIONS])
    return _let(text.visible(body), lambda seen: _let(needles.folded(seen), lambda low: flags(seen, low)))


def injections(body: Column) -> Column:
    """Array of (kind, detail) for the first match of each pattern in the visible text."""

    def found(seen: Column, low: Column) -> Column:
        each = [F.when(_hit(seen, low, p), F.struct(F.lit(k).alias("kind"), F.left(F.regexp_extract(seen, f"(?i){p}", 0), F.lit(120)).alias("detail"))) for p, k in fixed.INJECTIONS]
        return F.array_compact(F.array(*each))

    return _let(text.visible(body), lambda seen: _let(needles.folded(seen), lambda low: found(seen, low)))


def n_injections(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda n, x: n + x)


def trust_score(body: Column, hidden: Column | int = 0, https: Column | bool = True, llms: Column | bool = False, structured: Column | bool = False, flags: Column | None = None) -> Column:
    """0 to 100. Bonuses are capped at 100 where they are added; the whole is clamped last. ``flags`` are ``hits`` if they are known."""
    hidden, https, llms, structured = (x if isinstance(x, Column) else F.lit(x) for x in (hidden, https, llms, structured))

    def scored(found: Column) -> Column:
        each = [(F.get(found, F.lit(i)), k) for i, (_, k) in enumerate(fixed.INJECTIONS)]
        backed = _sum([h for h, k in each if k in CORROBORATING])
        score = F.lit(100) - _sum([h * fixed.PENALTY[k] for h, k in each])
        score = score - F.least(text.count_of(body, fixed.ZERO_WIDTH), F.lit(15)) - F.least(3 * text.count_of(body, fixed.BIDI), F.lit(20))
        score = score - F.when(hidden == 0, 0).when(backed > 0, F.least(4 * hidden, F.lit(20))).when(hidden > 60, 5).otherwise(0)
        score = score - F.when(https, 0).otherwise(15)
        score = F.when(llms, F.least(score + 5, F.lit(100))).otherwise(score)
        score = F.when(structured, F.least(score + 3, F.lit(100))).otherwise(score)
        return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")

    return _let(hits(body) if flags is None else flags, scored)


def verdict(score: Column) -> Column:
    return F.when(score >= 85, "TRUSTED").when(score >= 60, "CAUTION").otherwise("HOSTILE")


def sanitize(body: Column, size: int = 20_000) -> Column:
    seen = F.regexp_replace(text.visible(body), r"(?i)<\|?(im_start|im_end|system|assistant)\|?>", "[redacted]")
    return F.left(F.regexp_replace(seen, r"(?i)\[/?INST\]|<<SYS>>", "[redacted]"), F.lit(size))
