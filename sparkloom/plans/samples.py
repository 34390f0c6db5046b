"""A text that a pattern matches, for literal rows that must fire; tokens are put together here and stored nowhere."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser as parser

CLASSES = {op.CATEGORY_DIGIT: "79", op.CATEGORY_SPACE: " ", op.CATEGORY_WORD: "wv", op.CATEGORY_NOT_SPACE: "xq7", op.CATEGORY_NOT_DIGIT: "xq", op.CATEGORY_NOT_WORD: " "}
#: An edge of a word; between two of its characters it becomes a blank.
EDGE = "\0"


def _one(members: list, nth: int) -> str:
    """A character of a set, another one for each place, so that no long run of one digit makes a placeholder."""
    if members[0][0] is op.NEGATE:
        bad = "".join(chr(v) for k, v in members[1:] if k is op.LITERAL)
        fit = [c for c in "qz7 ;" if c not in bad and not any(k is op.CATEGORY and c in CLASSES[v] for k, v in members[1:])]
        return fit[nth % min(3, len(fit))]
    some: list[str] = []
    for kind, value in members:
        if kind is op.LITERAL:
            some.append(chr(value))
        elif kind is op.RANGE:
            some += [chr(c) for c in range(value[0], min(value[1], value[0] + 5) + 1)]
        elif kind is op.CATEGORY:
            some += CLASSES[value]
    return some[nth % len(some)]


def _text(parts: Iterable) -> str:
    out = ""
    for kind, value in parts:
        if kind is op.LITERAL:
            out += chr(value)
        elif kind is op.NOT_LITERAL:
            out += "q" if value != ord("q") else "z"
        elif kind is op.ANY:
            out += "q"
        elif kind is op.IN:
            out += _one(value, len(out))
        elif kind is op.SUBPATTERN:
            out += _text(value[3])
        elif kind is op.BRANCH:
            out += _text(value[1][0])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            for _ in range(value[0]):
                nth = len(out)
                inner = value[2][0]
                out += _one(inner[1], nth) if len(value[2]) == 1 and inner[0] is op.IN else _text(value[2])
        elif kind is op.ASSERT and value[0] > 0:
            out += " " + _text(value[1])
        elif kind is op.AT and value is op.AT_BOUNDARY:
            out += EDGE
    return out


@functools.cache
def sample(pattern: str) -> str:
    """A text with a match of ``pattern``, with words before and after it if it needs no edge."""
    found = re.sub(rf"(?<=\w){EDGE}+(?=\w)", " ", _text(parser.parse(pattern))).replace(EDGE, "")
    return next((t for t in (found, f"{found} ", f" {found}", f"{found}\n", f"{found}x", f"x{found}") if re.search(pattern, t)), found)
