"""Stateful rules on streams: only the state is held, keyed, in the state store.

The folds are those of ``sparkloom.operators.state``; a stream that holds the same events in the same order gives the
same decisions. With ``ttl_ms``, state is dropped when its key has been silent that long (processing time); a stream that
should end by itself (``availableNow``) needs it unset, as a pending timeout asks for one more batch without end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timeout(ttl_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout


def cooldown(stream: DataFrame, key: str, at: str, gap: float, ttl_ms: int | None = None) -> DataFrame:
    """(key, at, accepted): an event is accepted ``gap`` seconds or more after the last accepted one of its key."""

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for frame in frames:
            times, kept = sorted(frame["at"].tolist()), []
            for t in times:
                kept.append(last is None or t - last >= gap)
                last = t if kept[-1] else last
            yield pd.DataFrame({"key": own[0], "at": times, "accepted": kept})
        state.update((last,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("double").alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, at double, accepted boolean", "last double", "append", _timeout(ttl_ms))


def adaptive_limit(stream: DataFrame, key: str, at: str, kind: str, start: int = 6, top: int = 12, ttl_ms: int | None = None) -> DataFrame:
    """(key, limit, ok, throttled, errors) of each key after each batch that has its events."""

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limit, row, ok, slow, errors = state.get if state.exists else (start, 0, 0, 0, 0)
        events = pd.concat(list(frames)).sort_values("at", kind="stable")
        for k in events["kind"]:
            if k == "ok":
                ok, row, slow = ok + 1, row + 1, 0
                if row >= 5 and limit < top:
                    limit, row = limit + 1, 0
            elif k == "throttled":
                slow, row, limit = slow + 1, 0, max(1, limit // 2)
            else:
                errors, row = errors + 1, 0
        state.update((limit, row, ok, slow, errors))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [own[0]], "limit": [limit], "ok": [ok], "throttled": [slow], "errors": [errors]})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("double").alias("at"), F.col(kind).alias("kind"))
    held = "limit long, row long, ok long, throttled long, errors long"
    return rows.groupBy("key").applyInPandasWithState(step, "key string, limit long, ok long, throttled long, errors long", held, "update", _timeout(ttl_ms))


def once(stream: DataFrame, token: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first event of each token; tokens are forgotten when the watermark has passed them."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([token])


def kinds_by_window(stream: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, kind, n): counts of each kind of event in tumbling windows."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")
