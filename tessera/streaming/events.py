"""Streams of job events: their states as they arrive, and counts by window (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, attempts long, seq long, late long, newest long"
OUTPUT = "job_id long, status string, attempts long, late long"
FINAL = ("completed", "cancelled", "failed")


def _advance(status: str, attempts: int, event: str, most_attempts: int) -> tuple[str, int]:
    if event == "requeue":
        return "queued", 0
    if status in FINAL:  # only a requeue leaves these
        return status, attempts
    if event == "claim":
        return "running", attempts + 1
    if event == "fail":
        return ("failed" if attempts >= most_attempts else "queued"), attempts
    if event == "defer":
        return "queued", max(0, attempts - 1)
    return {"enqueue": "queued", "complete": "completed", "cancel": "cancelled"}.get(event, status), attempts


def job_states(events: DataFrame, lease_seconds: int = 60, most_attempts: int = 3, late: str = "10 minutes") -> DataFrame:
    """A row for each change of a job; a running job that stays silent beyond its lease is queued again.

    ``events``: job_id, seq, event, at (timestamp). Leases run in event time, so a replay
    gives the same states: a lease ends when the watermark, ``late`` behind the newest
    event, passes it. Within a micro-batch a job's events are taken in the order of seq.
    One that comes in a later batch than an event with its number or a larger one isn't
    applied, and counts in ``late``; what is older than the watermark is left out. After
    complete, cancel or the last failure only requeue has an effect.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, seen, late, newest = state.get if state.exists else ("queued", 0, -1, 0, 0)
        if state.hasTimedOut:
            status = "queued" if status == "running" else status
        else:
            before = seen
            for row in pd.concat(list(batches)).sort_values("seq").itertuples():
                if row.seq <= before:
                    late += 1
                elif row.seq > seen:
                    status, attempts = _advance(status, attempts, row.event, most_attempts)
                    seen, newest = row.seq, int(row.at.timestamp() * 1000)
        state.update((status, int(attempts), int(seen), int(late), int(newest)))
        if status == "running":
            state.setTimeoutTimestamp(max(newest + lease_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [int(attempts)], "late": [int(late)]})

    return events.withWatermark("at", late).groupBy("job_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type and window of event time; what comes later than ``late`` is left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
