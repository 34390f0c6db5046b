"""Typed fields of pages: a schema names fields, and a value counts only if the page's bytes show it.

A page gives each field by its selector: a field of the page, ``jsonld:`` and a property on whose value all data blocks
agree, or the first line of the text that has the hint. Values that do not fit the type, or are not literally there, are
missing. A null page has no field; pages that may not be read, or were not found, give an error for every field.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import fixed
from sparkloom.operators import html as pages

#: Bounds of a schema, of an excerpt, and of a text that is evidence as a whole.
MOST_BYTES, MOST_FIELDS, MOST_HINT, MOST_EXCERPT, MOST_NODES = 8192, 16, 240, 1000, 32
VALUE = "array<struct<field:string,type:string,value:string,method:string,excerpt:string,locator:string>>"


@dataclass(frozen=True)
class Field:
    type: str
    selector: str | None = None
    hint: str = ""
    required: bool = False


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len(dict(pairs)) < len(pairs):
        raise ValueError("a key stands twice")
    return dict(pairs)


def _is_selector(value: object) -> bool:
    if not isinstance(value, str):
        return False
    head, found, name = value.partition("jsonld:")
    return value in fixed.SELECTORS or bool(not head and found and re.fullmatch(fixed.PROPERTY_NAME, name))


def parse_schema(text: str) -> dict[str, Field]:
    """Fields of a schema in JSON; ``ValueError`` says what is wrong with the first bad part."""
    if not isinstance(text, str) or len(text.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        raise ValueError(f"a schema is JSON of at most {MOST_BYTES} bytes")
    try:
        whole = json.loads(text, object_pairs_hook=_once)
    except ValueError as error:
        raise ValueError(f"no JSON: {error}") from None
    if not isinstance(whole, dict) or not 1 <= len(whole) <= MOST_FIELDS:
        raise ValueError(f"a schema has 1 to {MOST_FIELDS} fields")
    out = {}
    for name, item in whole.items():
        if not re.fullmatch(fixed.FIELD_NAME, name):
            raise ValueError("a bad field name")
        known = isinstance(item, dict) and set(item) <= {"type", "selector", "hint", "required"}
        checks = {
            "specification": known,
            "type": known and item.get("type") in fixed.FIELD_TYPES,
            "hint": known and isinstance(item.get("hint", ""), str) and len(item.get("hint", "")) <= MOST_HINT,
            "required": known and isinstance(item.get("required", False), bool),
            "selector": known and (item.get("selector") is None or _is_selector(item["selector"])),
        }
        bad = next((k for k, fine in checks.items() if not fine), None)
        if bad:
            raise ValueError(f"a bad {bad}: {name}")
        out[name] = Field(item["type"], item.get("selector"), item.get("hint", ""), item.get("required", False))
    return out


def _number(value: object) -> int | float | None:
    if isinstance(value, str) and re.fullmatch(fixed.NUMBER, value.strip()):
        return float(value) if "." in value else int(value)
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _boolean(value: object) -> bool | None:
    return {"true": True, "false": False}.get(value.lower()) if isinstance(value, str) else value if isinstance(value, bool) else None


def _strings(value: object) -> list[str] | None:
    return value if isinstance(value, list) and value and all(isinstance(x, str) and x for x in value) else None


TYPES = {"string": lambda v: v if isinstance(v, str) and v else None, "number": _number, "boolean": _boolean, "string[]": _strings}


def _shown(value: object) -> Iterable[str]:
    """How a value may stand in a page."""
    return (str(value).lower() if isinstance(value, bool) else str(value),)


def _data_value(page: dict, name: str) -> tuple[object, str | None]:
    blocks = [json.loads(x) for x in page["json_ld"]]
    found = [(i, x[name]) for i, x in enumerate(blocks) if isinstance(x, dict) and name in x]
    agreed = bool(found) and all(v == found[0][1] for _, v in found)
    return (found[0][1], f"jsonld[{found[0][0]}].{name}") if agreed else (None, None)


def field_value(page: dict, raw: str, name: str, spec: Field) -> tuple[object, object, str | None]:
    """(value, excerpt, locator); all None where the page does not show the field."""
    none = (None, None, None)
    plain = {
        "title": page["title"], "description": page["description"], "canonical": page["canonical"], "lang": page["lang"], "text": page["text"],
        "h1": next((t for level, t in page["headings"] if level == 1), ""), "headings": [t for _, t in page["headings"]], "links": [href for href, _ in page["links"]],
    }
    selector = spec.selector or (name if name in plain else None)
    if selector is None:
        return none
    of_data = selector.startswith("jsonld:")
    found, locator = _data_value(page, selector.removeprefix("jsonld:")) if of_data else (plain[selector], selector)
    if selector == "text" and spec.hint:
        found = next((line.strip() for line in page["text"].splitlines() if spec.hint.lower() in line.lower()), None)
    value = TYPES[spec.type](found)
    if value is None:
        return none
    if selector == "text" and not spec.hint:
        nodes = page["text_nodes"]
        whole = nodes and len(nodes) <= MOST_NODES and sum(map(len, nodes)) <= MOST_EXCERPT and all(n in raw for n in nodes)
        return (value, list(nodes), locator) if whole else none
    literals = [next((s for s in _shown(x) if s in raw), None) for x in (value if isinstance(value, list) else [value])]
    if None in literals:
        return none
    if not of_data:
        return value, literals if isinstance(value, list) else literals[0], locator
    # The literal must be that of the property itself.
    own = re.search(rf"""["']{re.escape(selector.removeprefix("jsonld:"))}["']\s*:\s*["']?{re.escape(literals[0])}["']?(?=\s*[,}}\]]|$)""", raw)
    return (value, own[0], locator) if own else none


def fields(df: DataFrame, schema: Column | str, html: str = "html", out: str = "fields", ended: bool = False) -> DataFrame:
    """``df`` with ``out``: (field, type, value, method, excerpt, locator) of each field of each row's schema; values and excerpts in JSON."""
    dump = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)

    @F.pandas_udf(VALUE)
    def extract(bodies: pd.Series, schemas: pd.Series) -> pd.Series:
        rows = []
        for body, text in zip(bodies, schemas, strict=True):
            page, own = pages.read_page(body, True, ended), []
            for name, spec in parse_schema(text).items():
                value, excerpt, locator = field_value(page, body or "", name, spec)
                own.append({"field": name, "type": spec.type, "value": dump(value), "method": "missing" if value is None else "deterministic", "excerpt": dump(excerpt), "locator": locator})
            rows.append(own)
        return pd.Series(rows)

    return df.withColumn(out, extract(F.col(html), F.lit(schema) if isinstance(schema, str) else schema))


def extracted(df: DataFrame, schema: Column | str, html: str = "html", status: Column | None = None, allowed: Column | None = None, ended: bool = False) -> DataFrame:
    """``fields`` and ``outcome``: ok, access_denied, payment_required or http_ and the status; no field has a value unless ok.

    ``missing`` and ``invalid`` list the fields without a value, and the required ones among them.
    """
    code = F.lit(200) if status is None else status
    outcome = F.when(~F.coalesce(F.lit(True) if allowed is None else allowed, F.lit(False)), "access_denied").when(code == 402, "payment_required").when(code != 200, F.concat(F.lit("http_"), code.cast("string"))).otherwise("ok")
    rows = fields(df.withColumn("outcome", outcome), schema, html, ended=ended)
    null = F.lit(None).cast("string")
    barred = F.transform("fields", lambda x: F.struct(x["field"].alias("field"), x["type"].alias("type"), null.alias("value"), F.lit("error").alias("method"), null.alias("excerpt"), null.alias("locator")))
    rows = rows.withColumn("fields", F.when(F.col("outcome") == "ok", F.col("fields")).otherwise(barred))
    asked = F.from_json(F.lit(schema) if isinstance(schema, str) else schema, "map<string,struct<required:boolean>>")
    missing = F.transform(F.filter("fields", lambda x: x["value"].isNull()), lambda x: x["field"])
    return rows.withColumn("missing", missing).withColumn("invalid", F.filter(missing, lambda name: F.coalesce(F.try_element_at(asked, name)["required"], F.lit(False))))


def supported(value: Column, kind: Column, excerpt: Column, source: Column) -> Column:
    """Whether an excerpt of a source shows a value (as text; a list in JSON) of a type."""
    inside = (excerpt != "") & F.contains(source, excerpt) & (F.length(excerpt) <= MOST_EXCERPT)
    number = value.rlike(rf"^\s*(?:{fixed.NUMBER})\s*$") & F.exists(F.regexp_extract_all(excerpt, F.lit(fixed.NUMBER), F.lit(0)), lambda x: x.try_cast("double") == F.trim(value).try_cast("double"))
    boolean = F.lower(value).isin("true", "false") & F.lower(excerpt).rlike(r"\btrue\b") & (F.lower(value) == "true") | F.lower(excerpt).rlike(r"\bfalse\b") & (F.lower(value) == "false")
    items = F.from_json(value, "array<string>")
    listed = (F.size(items) > 0) & F.forall(items, lambda x: (x != "") & F.contains(excerpt, x))
    fits = F.when(kind == "string", (value != "") & F.contains(excerpt, F.trim(value))).when(kind == "number", number).when(kind == "boolean", boolean).when(kind == "string[]", listed).otherwise(False)
    return F.coalesce(inside & fits, F.lit(False))


def measured(rows: DataFrame, want: Column, got: Column) -> DataFrame:
    """(tp, fp, fn, wrong_abstain, precision, recall, abstention) of values against those expected; null is no value."""
    right, none = want.eqNullSafe(got), got.isNull()
    counts = rows.agg(
        F.count_if(want.isNotNull() & right).alias("tp"), F.count_if(~none & ~right).alias("fp"), F.count_if(want.isNotNull() & none).alias("fn"), F.count_if(want.isNull() & ~none).alias("wrong_abstain"), F.count_if(want.isNull() & none).alias("ca")
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.expr(b)), 4)
    return counts.select("tp", "fp", "fn", "wrong_abstain", share("tp", "tp + fp").alias("precision"), share("tp", "tp + fn").alias("recall"), share("ca", "ca + wrong_abstain").alias("abstention"))
