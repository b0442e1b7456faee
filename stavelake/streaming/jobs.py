"""Job events: progress lines, latest state and retention, as batch tables and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINISHED = ("completed", "failed")


def parsed_progress(events: DataFrame) -> DataFrame:
    """Adds sheet, current and total from lines such as ``sheet #3 12/40``; works on a batch and on a stream."""
    number = lambda pattern: F.regexp_extract("line", pattern, 1).try_cast("int")
    return events.withColumns({"sheet": number(r"sheet #(\d+)"), "current": number(r"(\d+)/\d+"), "total": number(r"\d+/(\d+)")})


def latest_progress(events: DataFrame) -> DataFrame:
    """The last state of each job; what comes after it has finished is ignored. One shuffle, combined before it."""
    done = F.min(F.when(F.col("status").isin(*FINISHED), F.struct("event_id", "status", "progress")))
    last = F.max(F.struct("event_id", "status", "progress"))
    per = events.groupBy("job_id").agg(F.coalesce(done, last).alias("x"))
    return per.select("job_id", "x.status", "x.progress")


def retained(events: DataFrame, hours: int = 24) -> DataFrame:
    """Jobs that are unfinished or had an event in the last hours of the log."""
    now = events.agg(F.max("ts")).scalar()
    per = events.groupBy("job_id").agg(F.bool_or(F.col("status").isin(*FINISHED)).alias("finished"), F.max("ts").alias("last"))
    return per.filter(~(F.col("finished") & (F.col("last") < now - F.expr(f"INTERVAL {hours} HOURS")))).select("job_id")


def latest_progress_expiring(events: DataFrame, hours: int = 24) -> DataFrame:
    """The last state of each job that a batch touched, for update mode; the state of a job goes when the watermark is ``hours`` past its last event.

    Events that are ``hours`` behind the newest one are dropped as late. Within that time the order of arrival does not matter: the first finish wins, else the newest event.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema}
    keep = hours * 3_600_000

    def latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = tuple(state.get) if state.exists else None
        until = state.getCurrentWatermarkMs()
        for frame in frames:
            until = max(until, int(frame["at"].max()))
            for row in zip(frame["event_id"].tolist(), frame["status"].tolist(), frame["progress"].tolist()):
                done = row[1] in FINISHED
                was_done = known is not None and known[1] in FINISHED
                if known is None or (done and (not was_done or row[0] < known[0])) or (not done and not was_done and row[0] > known[0]):
                    known = row
        state.update(known)
        state.setTimeoutTimestamp(until + keep)
        yield pd.DataFrame({"job_id": [key[0]], "status": [known[1]], "progress": [known[2]]})

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{hours} hours").withColumn("at", F.unix_millis("ts"))
    state = f"event_id {kind['event_id']}, status string, progress {kind['progress']}"
    out = f"job_id {kind['job_id']}, status string, progress {kind['progress']}"
    return rows.select("job_id", "event_id", "status", "progress", "ts", "at").groupBy("job_id").applyInPandasWithState(latest, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def finished_per_window(events: DataFrame, late: str = "24 hours", window: str = "15 minutes") -> DataFrame:
    """Finished jobs per window; the watermark bounds the state and drops later events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).filter(F.col("status").isin(*FINISHED))
    return rows.groupBy(F.window("ts", window).alias("w"), "status").agg(F.count("*").alias("n")).select("w.start", "w.end", "status", "n")
