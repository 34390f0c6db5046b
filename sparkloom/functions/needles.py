"""Strings that every match of an expression has, so that most texts need no expression at all."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literals(parts: Iterable) -> frozenset[str] | None:
    """Strings one of which is in any match, in lower case; the set whose shortest is longest, or None."""
    found, run = [], ""
    for kind, value in [*parts, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset((run,)))
        run, inner = "", None
        if kind is op.SUBPATTERN:
            inner = _literals(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            inner = _literals(value[2])
        elif kind is op.BRANCH:
            ways = [_literals(x) for x in value[1]]
            inner = None if None in ways else frozenset().union(*ways)
        if inner:
            found.append(inner)
    return max((frozenset(fold(x) for x in s) for s in found), key=lambda s: min(map(len, s)), default=None)


def _is_solid(members: list) -> bool:
    """Whether a set of characters has no blank."""
    kinds = [v for k, v in members if k is op.CATEGORY]
    if members[0][0] is op.NEGATE:
        return op.CATEGORY_SPACE in kinds
    spans = [(v, v) if k is op.LITERAL else v for k, v in members if k in (op.LITERAL, op.RANGE)]
    return all(k in (op.CATEGORY_DIGIT, op.CATEGORY_WORD, op.CATEGORY_NOT_SPACE) for k in kinds) and not any(chr(c).isspace() for low, high in spans for c in range(low, high + 1))


def _solid(parts: Iterable) -> tuple[int, bool]:
    """The least length of the longest piece without blanks in any match, and whether no match has a blank."""
    best, run, whole = 0, 0, True
    for kind, value in parts:
        inner, solid = 0, False
        if kind is op.LITERAL:
            inner, solid = 1, not chr(value).isspace()
        elif kind is op.IN:
            inner, solid = 1, _is_solid(value)
        elif kind is op.SUBPATTERN:
            inner, solid = _solid(value[3])
        elif kind is op.BRANCH:
            ways = [_solid(x) for x in value[1]]
            inner, solid = min(n for n, _ in ways), all(x for _, x in ways)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            inner, solid = _solid(value[2])
            inner = inner * value[0] if solid else inner if value[0] else 0
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            solid = True
        if solid:
            run += inner
        else:
            best, run, whole = max(best, run, inner if kind not in (op.LITERAL, op.IN) else 0), 0, False
    return max(best, run), whole


@functools.cache
def solid(pattern: str) -> int:
    """How long a piece without blanks every match has; a text without a piece so long has no match."""
    return _solid(parser.parse(pattern))[0]


def longest(text: str) -> int:
    """The longest piece of a text without blanks."""
    return max(map(len, text.split()), default=0)


def fold(value: str) -> str:
    """Lower case, with the letters that match i and s in any case."""
    return value.lower().replace("ı", "i").replace("ſ", "s")


@functools.cache
def needles(pattern: str) -> tuple[str, ...]:
    """Strings one of which every match has, once folded; none if the pattern names no text."""
    return tuple(sorted(_literals(parser.parse(pattern)) or ()))


@functools.cache
def hints(pattern: str) -> tuple[str, ...]:
    """Strings one of which every text with a match has, once folded: those of the match, or else those it must stand before."""
    ahead = [_literals(value[1]) for kind, value in parser.parse(pattern) if kind is op.ASSERT and value[0] > 0]
    return needles(pattern) or tuple(sorted(next((x for x in ahead if x), ())))


def folded(text: Column) -> Column:
    """The same as ``fold``."""
    return F.lower(F.translate(text, "ıſ\u212a", "isk"))


def likely(low: Column, pattern: str) -> Column:
    """Whether a folded text has one of the strings that a match of ``pattern`` must have."""
    some = needles(pattern)
    return functools.reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in some]) if some else F.lit(True)
