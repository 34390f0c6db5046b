"""Stateful rules in batch: folds over each key's events in order.

Events are dealt by key and sorted, and a fold walks over them batch by batch with the state of one key at a time, so a
key may have any number of events. Rules whose state is one accepted event (cooldown) or two numbers (budget) are greedy:
a refused event changes nothing, and later ones may still be accepted, so windows alone cannot state them. Streaming
forms are in ``sparkloom.streaming``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], start: Callable[[], list], step: Callable[[list, tuple], object], out: str) -> DataFrame:
    """``df`` with one more column, ``out`` ("name type"): what ``step`` returns for each row's ``values``.

    Each key's rows are taken in order, with a state that ``start`` makes and ``step`` changes. A null key is a key.
    """
    field = StructType.fromDDL(out).fields[0]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, own, state, begun = to_arrow_type(field.dataType), None, None, False
        for batch in batches:
            lists = [[batch.column(n).to_pylist() for n in names] for names in (keys, values)]
            results = []
            for i in range(batch.num_rows):
                key = [x[i] for x in lists[0]]
                if not begun or key != own:
                    own, state, begun = key, start(), True
                results.append(step(state, tuple(x[i] for x in lists[1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, kind)], [*batch.schema.names, field.name])

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(walk, StructType([*df.schema.fields, field]))


def cooldown(df: DataFrame, keys: list[str], at: str, order: str, gap: float, exempt: Column | None = None) -> DataFrame:
    """(keys, events, accepted): an event is accepted ``gap`` seconds or more after the last accepted one.

    Exempt events are accepted at any time and start no wait.
    """

    def step(last: list, row: tuple) -> bool:
        if row[1]:
            return True
        if last[0] is not None and row[0] - last[0] < gap:
            return False
        last[0] = row[0]
        return True

    free = F.coalesce(F.lit(False) if exempt is None else exempt, F.lit(False))
    rows = df.select(*keys, F.col(at).cast("double").alias("t"), F.col(order).alias("o"), free.alias("free"))
    passed = folded(rows, keys, ["t", "o"], ["t", "free"], lambda: [None], step, "passed boolean")
    return passed.groupBy(*keys).agg(F.count("*").alias("events"), F.count_if("passed").alias("accepted"))


def spend(df: DataFrame, keys: list[str], order: str, price: str, each: float, total: float) -> DataFrame:
    """(keys, accepted, spent): a price is paid if it is at most ``each`` and still fits in ``total``."""

    def step(spent: list, row: tuple) -> bool:
        if row[0] is None or row[0] > each or spent[0] + row[0] > total:
            return False
        spent[0] += row[0]
        return True

    rows = df.select(*keys, F.col(order).alias("o"), F.col(price).cast("decimal(18,2)").alias("p"))
    paid = folded(rows, keys, ["o", "p"], ["p"], lambda: [Decimal(0)], step, "paid boolean")
    return paid.groupBy(*keys).agg(F.count_if("paid").alias("accepted"), F.sum(F.when(F.col("paid"), F.col("p")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("spent"))


def daily_budget(df: DataFrame, keys: list[str], at: str, order: list[str], most: int, gap: float, request: str | None = None) -> DataFrame:
    """(keys, day, accepted): up to ``most`` requests a UTC day, each ``gap`` seconds or more after the last accepted.

    Requests come in the given order; one whose clock runs back behind the last accepted is refused, and so is an id that
    was accepted on its day. A new day begins without a last request.
    """

    def step(held: list, row: tuple) -> bool:
        t, name = row
        day, last, ids = held
        if t is None or (day is not None and (t // 86400 < day or t < last)):
            return False
        if day is None or t // 86400 > day:
            held[:] = day, last, ids = t // 86400, 0, []
        if (name is not None and name in ids) or len(ids) >= most or (last and t - last < gap):
            return False
        held[1] = t
        ids.append(name)
        return True

    name = F.col(request).cast("string") if request else F.lit(None).cast("string")
    rows = df.select(*keys, F.col(at).cast("double").alias("t"), name.alias("r"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    passed = folded(rows, keys, [f"o{i}" for i in range(len(order))], ["t", "r"], lambda: [None, 0, []], step, "passed boolean")
    return passed.withColumn("day", F.floor(F.col("t") / 86400).cast("long")).groupBy(*keys, "day").agg(F.count_if("passed").alias("accepted"))


def adaptive_limit(df: DataFrame, keys: list[str], order: list[str], kind: str, start: int = 6, top: int = 12) -> DataFrame:
    """(keys, limit, ok, throttled, errors) after all outcomes (ok, throttled, error): one more after five in a row, half when throttled."""

    def step(held: list, row: tuple) -> dict[str, int]:
        limit, streak, ok, slow, bad, n = held
        if row[0] == "ok":
            grows = streak + 1 >= 5 and limit < top
            held[:] = limit + grows, 0 if grows else streak + 1, ok + 1, 0, bad, n + 1
        elif row[0] == "throttled":
            held[:] = max(1, limit // 2), 0, ok, slow + 1, bad, n + 1
        else:
            held[:] = limit, 0, ok, slow, bad + 1, n + 1
        return {"n": held[5], "limit": held[0], "ok": held[2], "throttled": held[3], "errors": held[4]}

    rows = df.select(*keys, *order, F.col(kind).alias("k"))
    stepped = folded(rows, keys, [*order, "k"], ["k"], lambda: [start, 0, 0, 0, 0, 0], step, "s struct<n:bigint,limit:bigint,ok:bigint,throttled:bigint,errors:bigint>")
    last = stepped.groupBy(*keys).agg(F.max("s").alias("s"))
    return last.select(*keys, "s.limit", "s.ok", "s.throttled", "s.errors")


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a number, or a date in HTTP's form; null for anything else."""
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")).cast("double")
    return F.coalesce(F.when(value.rlike(r"^\s*\d+(\.\d+)?\s*$"), value.try_cast("double")), F.when(date.isNotNull(), F.greatest(date - now, F.lit(0.0))))


def pause(retry: Column, throttled: Column) -> Column:
    return F.coalesce(retry, F.least(F.pow(F.lit(2.0), F.least(throttled, F.lit(4))), F.lit(10.0)))


def fresh_until(cache_control: Column, expires: Column, stored: Column) -> Column:
    """When a stored response goes stale; ``max-age=0`` falls through to ``Expires``."""
    age = F.regexp_extract(F.lower(F.coalesce(cache_control, F.lit(""))), r"max-age\s*=\s*(\d+)", 1).try_cast("double")
    barred = F.lower(F.coalesce(cache_control, F.lit(""))).rlike("no-store|no-cache")
    return F.when(barred, F.lit(0.0)).when(age > 0, stored + age).otherwise(F.coalesce(expires, F.lit(0.0)))


def cache_outcomes(df: DataFrame, key: str, at: str, order: str, ttl: float) -> DataFrame:
    """``df`` with ``outcome``: the first request of a key misses and stores; a later one hits until the stored time and
    ``ttl``, and then revalidates. Neither a hit nor a revalidation makes it fresh again."""
    first = df.groupBy(key).agg(F.min(F.struct(F.col(at).alias("at"), F.col(order).alias("o"))).alias("stored"))
    rows = df.join(first, df[key].eqNullSafe(first[key])).drop(first[key])
    age = F.col(at).cast("double") - F.col("stored.at").cast("double")
    missed = (F.col(at) == F.col("stored.at")) & (F.col(order) == F.col("stored.o"))
    return rows.withColumn("outcome", F.when(missed, "miss").when(age < ttl, "hit").otherwise("revalidated")).drop("stored")


def first_use(df: DataFrame, token: str, *order: str) -> DataFrame:
    """``df`` with ``replay``: whether the token was used before."""
    return df.withColumn("replay", F.row_number().over(Window.partitionBy(token).orderBy(*order)) > 1)


def token_uses(df: DataFrame, token: str, order: list[str], now: Column, begins: Column, ends: Column, scope: Column, wanted: str) -> DataFrame:
    """``df`` with ``outcome``: not yet valid, expired, missing scope, replay, or accepted; only an accepted use consumes a token."""
    early = F.when(F.coalesce(begins, F.lit(0)) != 0, now < begins)
    late = F.when(F.coalesce(ends, F.lit(0)) != 0, now > ends)
    bad = F.when(early, "not yet valid").when(late, "expired").when(~F.contains(F.coalesce(scope, F.lit("")), F.lit(wanted)), "missing scope")
    rows = df.withColumn("outcome", bad)
    first = rows.filter("outcome is null").groupBy(token).agg(F.min(F.struct(*order)).alias("used_at"))
    met = rows.join(first, token, "left")
    return met.withColumn("outcome", F.coalesce("outcome", F.when(F.struct(*order) == F.col("used_at"), "accepted").otherwise("replay"))).drop("used_at")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row written for each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def admit_prefix(df: DataFrame, group: str, order: str, size: str, files: int, total: int, each: int) -> DataFrame:
    """Rows of a group up to the first that overflows: at most ``files``, ``total`` in sum, each at most ``each``."""
    w = Window.partitionBy(group).orderBy(order)
    kept = df.filter(F.col(size) <= each)
    return kept.withColumn("nth", F.row_number().over(w)).withColumn("upto", F.sum(size).over(w)).filter((F.col("nth") <= files) & (F.col("upto") <= total)).drop("nth", "upto")
