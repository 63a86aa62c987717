"""Rate limits per key: fixed windows that restart with the first request after they end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def decide(times: np.ndarray, state: tuple[int, int] | None, window: int, most: int) -> tuple[np.ndarray, tuple[int, int]]:
    """Which requests (sorted, whole microseconds) are let through, and the state after them: (end of the window, count).

    One step a window, whatever number of requests it has.
    """
    ends, count = state or (np.iinfo(np.int64).min, 0)
    out, at = np.zeros(len(times), bool), 0
    while at < len(times):
        if times[at] >= ends:
            ends, count = int(times[at]) + window, 0
        to = int(np.searchsorted(times, ends, side="left"))
        out[at : at + max(0, most - count)] = True
        out[to:] = False
        count, at = count + to - at, to
    return out, (ends, count)


def decide_blocking(times: np.ndarray, state: tuple[int, int, int] | None, window: int, most: int, block: int) -> tuple[np.ndarray, tuple[int, int, int]]:
    """The same with a block: the request over the limit starts ``block`` in which nothing is let through.

    State: (start of the window, count, end of the block).  A window is over
    when a request comes ``window`` or more after its start.
    """
    start, count, blocked = state or (np.iinfo(np.int64).min // 2, 0, np.iinfo(np.int64).min)
    out, at = np.zeros(len(times), bool), 0
    while at < len(times):
        if times[at] < blocked:  # nothing counts until the block is over
            at = int(np.searchsorted(times, blocked, side="left"))
            continue
        if times[at] - start >= window:
            start, count = int(times[at]), 0
        to = int(np.searchsorted(times, start + window, side="left"))
        free = min(to - at, max(0, most - count))
        out[at : at + free] = True
        count, at = count + free, at + free
        if at < to:
            count, blocked = count + 1, int(times[at]) + block
            at += 1
    return out, (start, count, blocked)


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy()


def batch_limit(events: DataFrame, seconds: float, most: int, block: float | None = None) -> DataFrame:
    """(key, id, ts, allowed) for a table of requests (key, ts, id); with ``block`` seconds, a limiter that blocks.

    Windows of one key depend on all its earlier requests, so a key is dealt
    with in order of time; its rows stream through in batches with the small
    state carried over, and are never gathered.  Rows without key or time are
    left out.
    """
    own = events.filter("key is not null and ts is not null").select("key", "id", F.col("ts").cast("timestamp").alias("ts"))
    window, pause = round(seconds * 1e6), None if block is None else round(block * 1e6)

    def run(batches):
        key, state = None, None
        for pdf in batches:
            allowed, times = np.zeros(len(pdf), bool), _micros(pdf["ts"])
            keys = pdf["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if keys[a] != key:
                    key, state = keys[a], None
                allowed[a:b], state = decide(times[a:b], state, window, most) if pause is None else decide_blocking(times[a:b], state, window, most, pause)
            yield pdf.assign(allowed=allowed)

    kind = dict(own.dtypes)
    return own.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(run, f"key {kind['key']}, id {kind['id']}, ts timestamp, allowed boolean")


def stream_limit(events: DataFrame, seconds: float, most: int, late: str = "1 minute", block: float | None = None) -> DataFrame:
    """The same over a stream: state per key, dropped when event time has passed the end of its window and block.

    A trigger's requests of a key are put in order of time before any is
    decided; requests later than ``late`` are dropped, as the watermark says,
    and one that comes in a later trigger counts in the window that is open.
    """
    window, pause = round(seconds * 1e6), None if block is None else round(block * 1e6)

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "id"], ignore_index=True)
        times, held = _micros(pdf["ts"]), state.get if state.exists else None
        allowed, held = decide(times, held, window, most) if pause is None else decide_blocking(times, held, window, most, pause)
        state.update(held)
        over = held[0] if pause is None else max(held[0] + window, held[2])
        state.setTimeoutTimestamp(max(over // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": key[0], "id": pdf["id"], "ts": pdf["ts"], "allowed": allowed})

    kind = dict(events.dtypes)
    own = events.filter("key is not null and ts is not null").select("key", "id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    held = "ends long, count long" if pause is None else "start long, count long, blocked long"
    return own.groupBy("key").applyInPandasWithState(run, f"key {kind['key']}, id {kind['id']}, ts timestamp, allowed boolean", held, "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by type in tumbling windows, with late rows dropped after the watermark; batch frames work as well."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
