"""Streams of calls: the rolling limit with keyed state, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limited_stream(calls: DataFrame, window_seconds: float, most: int) -> DataFrame:
    """key, at, event_id, accepted and retry_after of a stream of calls (key, at, event_id).

    A key's state is the accepted times of one window, at most `most`. Within a micro-batch calls are decided in order of
    time; one that comes in a later batch is decided against what was accepted before it.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, event_id in zip(rows["at"], rows["event_id"], strict=True):
            times = [t for t in times if t > at - window_seconds]
            retry = max(1, ceil(times[0] + window_seconds - at)) if len(times) >= most else None
            if retry is None:
                times.append(at)
            out.append((key[0], at, event_id, retry is None, retry))
        state.update((times,))
        yield pd.DataFrame(out, columns=["key", "at", "event_id", "accepted", "retry_after"]).astype({"retry_after": "Int64"})

    kind = calls.schema["key"].dataType.simpleString()
    return calls.groupBy("key").applyInPandasWithState(
        decide, f"key {kind}, at double, event_id long, accepted boolean, retry_after long", "times array<double>", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events and their summed value by window and type; windows close once the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
