"""Personal data: regular expressions propose spans, checks confirm them, nearby words move the score.

Kinds and their checks:

``email``, ``phone``  the expression, and for phones 9 to 15 digits
``ip``                four parts of at most 255
``card``              13 to 19 digits that pass Luhn
``iban``              the length its country registers, and mod 97 of the rearranged letters and digits is 1
``ssn``               three, two and four digits in groups, only beside a word that names such a number
``secret``            a key of a known form, or a value given to a password or token: letters and digits, of at least
                      eight different characters

The first four are the base spans, which always stay. The others are added by score: an expression
gives 0.4, a passed checksum 0.4 more, a context word within ``NEAR`` characters 0.3 more, and a word that
speaks of examples 0.2 less; spans of at least ``LEAST_SCORE`` are kept. Positions count code points.

Matches are leftmost and do not overlap within a kind; one that fails its check is dropped and not tried
again in another shape. Of IBANs the expression only finds where one may begin, at every such place; the end
follows from the country's length, and for countries without one is that of the longest run. The expressions are written
so that no text takes more than linear time or a deep stack: where a run can start a match only at its first character, a
look-behind says so. Places of n spans are found in n log n steps; contexts are read from pieces of the text.

Defined results: a null text is an empty one; a text without personal data has empty lists; repeated rows each get their
own result; an empty table gives an empty one; ties in score change nothing, as spans are ordered by place; very long texts
and those of many spans take time nearly in proportion; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import free_name

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
#: What proposes a span of each kind.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b(?=[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|(?i:passw(?:or)?d|passphrase|pwd|token|secret|api[_-]?key)\x20?[:=]\x20?[\"']?[A-Za-z0-9+/_.-]{12,}+)",
}
#: A character that every match of the kind has, for a cheap first look.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-", "secret": None}
LOOKS = {"iban": "[A-Z]{2}[0-9]{2}", "card": r"[0-9][\x20-]?[0-9]"}
#: Beginnings of keys of known forms, and what stands before a value that is given to a name.
KEY_HEADS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
GIVEN = r"(?i:passw(?:or)?d|passphrase|pwd|token|secret|key)\x20?[:=]"
#: Words that speak for a kind, and words that speak against any.
CONTEXT = {
    "email": "mail|contact|write to|reply",
    "ip": "address|host|server|ip",
    "card": "card|credit|debit|visa|payment|pan",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|tax id",
    "secret": "login|access|account|credential|key",
}
AGAINST = "example|sample|test|dummy"
NEAR, LEAST_SCORE = 40, 0.7
#: Letters and digits of an IBAN, and the countries that have that length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: What stands between matches once they are marked. A NUL of the text is first made another control.
MARK = "\x00"
#: Characters of a piece of text, which is longer than any context or IBAN.
PIECE = 64
SPAN = "struct<kind:string,start:int,end:int,match:string>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = F.when((n - i) % 2 == 1, digit * 2).otherwise(digit)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has the check digits that its other characters ask for."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # Up to three digits after leading zeros; three digits compare as numbers do.
        solid = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(solid(p)) < 3) | ((F.length(solid(p)) == 3) & (solid(p) <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        solid = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(solid).between(15, 34), mod97(solid)).otherwise(False)
    if kind == "secret":
        value = F.regexp_extract(match, r"([A-Za-z0-9+/_.-]+)$", 1)
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _upto(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each place, all values up to it combined: in doubling steps, as a fold would copy what it holds for each value."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    back = lambda sums, i, k: F.get(sums, i - F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, values, lambda sums, k: F.transform(sums, lambda x, i: F.coalesce(combine(x, back(sums, i, k)), x)))


def _proposed(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, match) of the expression's matches: marked, split, and measured. Every second part is one."""
    parts = F.split(F.regexp_replace(text, f"({PATTERNS[kind]})", f"{MARK}$1{MARK}"), MARK)
    held = F.transform(F.array(parts), lambda p: F.struct(p.alias("parts"), _upto(F.transform(p, lambda x: F.length(x)), Column.__add__).alias("ends")))

    def spans(x: Column) -> Column:
        places = F.when(F.size(x["parts"]) > 1, F.sequence(F.lit(1), F.size(x["parts"]) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        part = lambda i: F.get(x["parts"], i)
        return F.transform(
            places, lambda i: F.struct(F.lit(kind).alias("kind"), F.get(x["ends"], i - 1).alias("start"), F.get(x["ends"], i).alias("end"), part(i).alias("match"))
        )

    return F.get(F.transform(held, spans), F.lit(0))


def _pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` characters, from which a few can be read without walking over all before them."""
    return F.split(F.regexp_replace(text, f"(?s)(.{{{PIECE}}})", f"$1{MARK}"), MARK)


def _read(pieces: Column, start: Column, n: Column | int) -> Column:
    """Up to ``n`` characters from ``start`` on, at most ``PIECE``."""
    at = F.floor(start / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, at), F.lit("")), F.coalesce(F.get(pieces, at + 1), F.lit("")))
    return F.substr(both, start % PIECE + 1, n if isinstance(n, Column) else F.lit(n))


def _ibans(pieces: Column, heads: Column) -> Column:
    """The IBANs that begin at ``heads``, leftmost first: in groups of four with or without blanks, up to a word's end."""

    def read(head: Column) -> Column:
        # One character more than the longest match, so that the end of this part is not taken for a word's end.
        ahead = _read(pieces, head["start"], 44)
        country, shape = F.substr(ahead, F.lit(1), F.lit(2)), F.lit(r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
        for n, names in IBAN_LENGTHS.items():
            groups, rest = divmod(n - 4, 4)
            own = rf"^[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}" + rf"(?:\x20?[A-Z0-9]{{{rest}}})" * (rest > 0) + r"\b"
            shape = F.when(country.isin(*names.split()), own).otherwise(shape)
        match = F.regexp_substr(ahead, shape)
        return F.struct(head["kind"].alias("kind"), head["start"].alias("start"), (head["start"] + F.length(match)).alias("end"), match.alias("match"))

    def listed(span: Column) -> Column:
        return F.substr(span["match"], F.lit(1), F.lit(2)).isin(*" ".join(IBAN_LENGTHS.values()).split())

    none = F.array().cast(f"array<{SPAN}>")

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        clear = F.when(F.size(out) > 0, last["end"] <= s["start"]).otherwise(True)
        # A country with a length goes before what only looks like one.
        better = F.when(~clear, ~listed(last) & listed(s)).otherwise(False)
        return F.when(clear, F.array_append(out, s)).when(better, F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), s)).otherwise(out)

    def settled(x: Column) -> Column:
        """Spans that overlap none before them begin groups of their own; only groups of several are folded."""
        spans, reach = x["spans"], x["reach"]
        firsts = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.coalesce(F.get(reach, i - 1) <= F.get(spans, i)["start"], F.lit(True)))

        def groups(f: Column) -> Column:
            group = lambda i, n: F.transform(F.sequence(i, F.coalesce(F.get(f, n + 1), F.size(spans)) - 1), lambda j: F.get(spans, j))
            return F.flatten(F.transform(f, lambda i, n: _let(group(i, n), lambda g: F.when(F.size(g) == 1, g).otherwise(F.aggregate(g, none, add)))))

        return F.when(F.size(spans) > 0, _let(firsts, groups)).otherwise(none)

    passed = F.filter(F.transform(heads, read), lambda s: F.when(s["match"].isNotNull(), _passes("iban", s["match"])).otherwise(False))
    with_reach = lambda p: F.struct(p.alias("spans"), _upto(F.transform(p, lambda s: s["end"]), F.greatest).alias("reach"))
    return _let(_let(passed, with_reach), settled)


def _score(pieces: Column, kind: str, span: Column) -> Column:
    begin = F.greatest(span["start"] - NEAR, F.lit(0))
    around = F.lower(F.concat(_read(pieces, begin, span["start"] - begin), F.lit(" "), _read(pieces, span["end"], NEAR)))
    checked = 0.4 if kind in ("card", "iban", "ip", "secret") else 0.0
    near = F.when(around.rlike(rf"\b(?:{CONTEXT[kind]})\b"), 0.3).otherwise(0.0)
    return F.round(F.lit(0.4 + checked) + near - F.when(around.rlike(rf"\b(?:{AGAINST})"), 0.2).otherwise(0.0), 2)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with ``out``: an array of (kind, start, end, score), by kind as listed above, then start."""
    own = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), MARK, "\x01")
    text_name, pieces_name = free_name(df, f"{out}_text"), free_name(df, f"{out}_pieces")
    names = {kind: free_name(df, f"{out}_{kind}") for kind in BASE + ADDED}
    work = df.withColumn(text_name, own)
    t, pieces = F.col(text_name), F.col(pieces_name)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    likely = {kind: F.contains(t, F.lit(NEEDS[kind])) if NEEDS[kind] else t.rlike(LOOKS[kind]) for kind in names if kind != "secret"}
    heads = functools.reduce(Column.__or__, [F.contains(t, F.lit(x)) for x in KEY_HEADS])
    likely["secret"] = heads | ((F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(GIVEN))
    work = work.withColumns({name: F.when(likely[kind], _proposed(t, kind)) for kind, name in names.items()})
    work = work.withColumn(pieces_name, F.when(functools.reduce(Column.__or__, [F.coalesce(F.size(n) > 0, F.lit(False)) for n in names.values()]), _pieces(t)))
    work = work.withColumn(names["iban"], F.when(F.size(names["iban"]) > 0, _ibans(pieces, F.col(names["iban"]))))
    kept = [F.coalesce(_kept(pieces, kind, F.col(name)), none) for kind, name in names.items()]
    return work.withColumn(out, F.concat(*kept)).drop(text_name, pieces_name, *names.values())


def _kept(pieces: Column, kind: str, spans: Column) -> Column:
    passed = F.filter(spans, lambda s: _passes(kind, s["match"]))
    scored = F.transform(passed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(pieces, kind, s).alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), one row per input row; ``n_spans`` counts all kinds."""
    found = find_pii(df.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias("pii_source")), "pii_source").drop("pii_source")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(doc_id, *[_count(kind) for kind in BASE], F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def redact(df: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """``df`` with ``out``: the text with every span replaced by its kind in brackets; overlaps become one."""
    found = find_pii(df, text, f"{out}_spans")
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    ordered = F.array_sort(F.transform(f"{out}_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    walked = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(own, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(own, acc["at"] + 1)),
    )
    return found.withColumn(out, walked).drop(f"{out}_spans")
