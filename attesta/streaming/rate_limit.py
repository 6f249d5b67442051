"""Sliding-window rate limiter: in batch by key, and as a stateful stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Seconds by which a stream's event times are led on: watermarks start at 1970, and times of a century before aren't late.
LEAD = 36_525 * 86_400


def decide(times: list[float], hits: deque, limit: int, window: float) -> list[tuple[bool, float]]:
    """(allowed, seconds to wait) for each time in order. Only allowed hits are remembered, so no window frame can say this."""
    out = []
    for t in times:
        while hits and hits[0] <= t - window:
            hits.popleft()
        if len(hits) < limit:
            hits.append(t)
            out.append((True, 0.0))
        else:
            out.append((False, hits[0] + window - t))
    return out


def _decided(g: pd.DataFrame, hits: deque, limit: int, window: float) -> pd.DataFrame:
    got = decide(g["t"].tolist(), hits, limit, window)
    return g.assign(allowed=[a for a, _ in got], retry_after=[round(w, 6) for _, w in got])[["key", "event", "allowed", "retry_after"]]


def rate_limit(events: DataFrame, key: str, ts: str, event: str, limit: int, window_seconds: float) -> DataFrame:
    """key, event (both as named), allowed and retry_after. A key is one client's sequence, decided in its order (time, then event).

    Sequential by nature, so a key's events stay in one task; they stream through it, and only the last hits (at most the limit) are kept.
    Events with a null key are one client's, those with a null time are never decided (allowed is null).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hits = None, deque()
        for frame in frames:
            for _, g in frame.groupby("run", sort=False):  # rows come by keys: runs are whole keys, but for the first and last of a frame
                if g["run"].iat[0] != last:
                    last, hits = g["run"].iat[0], deque()
                yield _decided(g, hits, limit, window_seconds)

    kind = events.schema[key].dataType.simpleString()
    named = events.select(F.col(key).alias("key"), F.col(event).cast("bigint").alias("event"), F.col(ts).cast("timestamp").cast("double").alias("t")).withColumn("run", F.to_json(F.struct("key")))
    out = f"key {kind}, event bigint, allowed boolean, retry_after double"
    timed = named.where("t IS NOT NULL").repartition("run").sortWithinPartitions("run", "t", "event").mapInPandas(run, out)
    untimed = named.where("t IS NULL").select("key", "event", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("double").alias("retry_after"))
    return timed.unionByName(untimed).withColumnsRenamed({"key": key, "event": event})


def rate_limit_stream(events: DataFrame, key: str, ts: str, event: str, limit: int, window_seconds: float, delay: str = "1 hour") -> DataFrame:
    """The same over a stream: the state of a key is its allowed hits inside the window, and goes once the watermark has passed their end.

    Rows of one batch are decided in time order; a row that is late, but not behind the watermark (the newest time less delay), counts as it comes. Rows at or behind
    the watermark are too late to be decided and have no result, as have those with a null time. Removing a state changes no decision: rows that can still
    come are outside the window of all its hits.
    """
    kind = events.schema[key].dataType.simpleString()
    named = events.select(F.col(key).alias("key"), F.col(event).cast("bigint").alias("event"), F.col(ts).cast("timestamp").alias("ts")).where("ts IS NOT NULL").withColumn("at", F.timestamp_micros(F.unix_micros("ts") + LEAD * 1_000_000)).withWatermark("at", delay)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        g = pd.concat(list(frames)).sort_values(["t", "event"])
        hits = deque(state.get[0] if state.exists else [])
        out = _decided(g, hits, limit, window_seconds)
        state.update((list(hits),))
        state.setTimeoutTimestamp(max(int((max(hits) + window_seconds + LEAD) * 1000), state.getCurrentWatermarkMs() + 1))
        yield out

    timed = named.select("key", "event", "at", F.col("ts").cast("double").alias("t"))
    return timed.groupBy("key").applyInPandasWithState(run, f"key {kind}, event bigint, allowed boolean, retry_after double", "hits array<double>", "append", "EventTimeTimeout").withColumnsRenamed({"key": key, "event": event})
