"""Keyed state over event streams: token buckets, start-end correlation, bounded history, and table writers.

Time is the events' own: a test that replays a stream gives the same result. State per key is bounded and expires with
the watermark where a time-out is named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(stream: DataFrame, key: str, capacity: float = 100.0, per_second: float = 10.0, time: str = "ts", order: str = "event_id") -> DataFrame:
    """key, event_id, ts, allowed, retry_after: a token bucket per key. The bucket starts full, refills by elapsed time up
    to its capacity, and an event passes if a whole token is left; an event that doesn't may come again after the seconds
    that one token takes. Events of one trigger are taken in the order of time and id, so a trigger should be small (the
    source's maxFilesPerTrigger); an event older than the bucket's clock refills nothing."""
    if capacity <= 0 or per_second <= 0:
        raise ValueError("capacity and rate must be positive")
    kinds = dict(stream.dtypes)
    wait = int(-(-1 // per_second))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, clock = state.get if state.exists else (capacity, None)
        rows = pd.concat([b[[order, time]] for b in batches]).sort_values([time, order])
        allowed = []
        for at in rows[time].astype("int64") // 1000 if str(rows[time].dtype) == "datetime64[ns]" else rows[time].astype("datetime64[us]").astype("int64"):
            if clock is not None and at > clock:
                tokens = min(capacity, tokens + (at - clock) / 1e6 * per_second)
            clock = at if clock is None else max(clock, at)
            ok = tokens >= 1
            tokens -= ok
            allowed.append(bool(ok))
        state.update((float(tokens), int(clock)))
        later = pd.array([None if ok else wait for ok in allowed], dtype="Int64")
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), time: rows[time].to_numpy(), "allowed": allowed, "retry_after": later})

    return stream.select(key, order, time).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {order} {kinds[order]}, {time} {kinds[time]}, allowed boolean, retry_after long", "tokens double, clock long", "append", GroupStateTimeout.NoTimeout
    )


def correlated(stream: DataFrame, start: str, end: str, key: str, within: str = "1 hour", kind: str = "event_type") -> DataFrame:
    """Starts joined with ends of the same key that follow within the time: a stream-stream join whose state the
    watermark clears."""
    s = stream.filter(F.col(kind) == start).select(F.col(key).alias("s_key"), F.col("ts").alias("s_ts"), F.col("event_id").alias("start_id")).withWatermark("s_ts", within)
    e = stream.filter(F.col(kind) == end).select(F.col(key).alias("e_key"), F.col("ts").alias("e_ts"), F.col("event_id").alias("end_id")).withWatermark("e_ts", within)
    near = F.expr(f"s_key = e_key AND e_ts >= s_ts AND e_ts <= s_ts + INTERVAL {within}")
    return s.join(e, near).select(F.col("s_key").alias(key), "start_id", "end_id", "s_ts", "e_ts")


def windowed_counts(stream: DataFrame, by: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """by, start, events, value: per tumbling window, closed when the watermark passes."""
    x = stream.withWatermark("ts", late).groupBy(F.window("ts", size), by).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return x.select(by, F.col("window.start").alias("start"), "events", "value")


def recent_history(stream: DataFrame, key: str, n: int) -> DataFrame:
    """key, event_ids: the last n events of each key by time and id, oldest first, after every trigger that brings one. No
    more than n events and one batch of a key are held at a time."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times = state.get if state.exists else ([], [])
        kept = list(zip(times, ids))
        for b in batches:
            micros = b["ts"].astype("datetime64[us]").astype("int64")
            kept = sorted([*kept, *zip(micros.tolist(), b["event_id"].tolist())])[-n:]
        ids, times = [i for _, i in kept], [t for t, _ in kept]
        state.update((ids, times))
        yield pd.DataFrame({key: [k[0]], "event_ids": [ids]})

    return stream.select(key, "ts", "event_id").groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, event_ids array<long>", "ids array<long>, times array<long>", "update", GroupStateTimeout.NoTimeout)


def distinct_rows(stream: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """The stream without rows that were delivered before, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def table_writer(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each trigger once: the batch number is a partition that is overwritten, so a
    trigger that runs again after a failure replaces its own rows; rows of one trigger are distinct by key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
