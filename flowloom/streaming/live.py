"""Directly-follows steps and activity counts over a stream of events.

A batch log is complete and is sorted; a stream is not. Per case, the last event is kept as state; an event that is not
older makes a step from it, an older one is told as out of order and makes none. State of a case goes when the watermark
has passed its last event by `idle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = "case_id string, from_activity string, to_activity string, ts timestamp, wait_days double, out_of_order boolean"
STATE = "activity string, us long"


def live_steps(events: DataFrame, late: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Steps of a stream (case_id, activity, ts): each as soon as its second event has come. Append mode."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():
            us = r.ts.value // 1000
            if last is not None:
                ahead = us >= last[1]
                out.append((key[0], last[0], r.activity, r.ts, (us - last[1]) / 86_400e6 if ahead else None, not ahead))
            if last is None or us >= last[1]:
                last = (r.activity, us)
        state.update(last)
        state.setTimeoutTimestamp(max(last[1] // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["case_id", "from_activity", "to_activity", "ts", "wait_days", "out_of_order"])

    watched = events.select("case_id", "activity", "ts").where("case_id <> '' and activity <> '' and ts is not null").withWatermark("ts", late)
    return watched.groupBy("case_id").applyInPandasWithState(run, STEPS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by activity and window of time; a window is told once the watermark has passed it."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window), "activity").agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), "activity", "n")
