"""Functions that the standard library states and built-in expressions do not: display width, canonical JSON, public addresses."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(character: str) -> int:
    return 2 if unicodedata.east_asian_width(character) in ("W", "F") else 1


def cells(value: str) -> int:
    """Cells that a text takes on a screen; combining characters take none."""
    return sum(_cells(c) for c in value if not unicodedata.combining(c))


def shortened(value: str, width: int) -> str:
    """The text, or as much of it as fits beside an ellipsis."""
    if cells(value) <= width:
        return value
    used, end = 0, 0
    for c in value:
        if used + _cells(c) > width - 1:
            break
        used, end = used + _cells(c), end + 1
    return value[:end] + "…"


def width(text: Column) -> Column:
    @F.pandas_udf("int")
    def measure(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else cells(v) for v in values], dtype="Int32")

    return measure(text)


def fitted(text: Column, size: int) -> Column:
    """A text cut or padded with blanks to exactly so many cells, or one less where a wide character would be cut."""

    @F.pandas_udf("string")
    def fit(values: pd.Series) -> pd.Series:
        cut = [None if v is None else shortened(v, size) for v in values]
        return pd.Series([None if v is None else v + " " * max(0, size - cells(v)) for v in cut])

    return fit(text)


def json_digest(text: Column) -> Column:
    """SHA-256 of a JSON text with its keys in order and no blanks, non-ASCII characters escaped; null if it is no JSON."""

    def digest(value: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(value), sort_keys=True, separators=(",", ":")).encode()).hexdigest() if value is not None else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def digests(values: pd.Series) -> pd.Series:
        return pd.Series([digest(v) for v in values])

    return digests(text)


def is_global(address: Column) -> Column:
    """Whether a text is an address that all of the internet can reach."""

    def reachable(value: str | None) -> bool:
        try:
            return value is not None and ipaddress.ip_address(value).is_global
        except ValueError:
            return False

    @F.pandas_udf("boolean")
    def look(values: pd.Series) -> pd.Series:
        return pd.Series([reachable(v) for v in values], dtype="boolean")

    return look(address)


def public_hosts(resolved: DataFrame) -> DataFrame:
    """(host, public) from (host, address), an address a row: public if there is one and all of them are global."""
    rows = resolved.withColumn("own", is_global(F.col("address")))
    return rows.groupBy("host").agg(F.bool_and("own").alias("public"))
