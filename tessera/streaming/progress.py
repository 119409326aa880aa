"""Streaming forms: workers' progress reports as an unbounded table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT = "worker int, branch int, clock long, progress double"


def complete_clocks(reports: DataFrame, workers: int) -> DataFrame:
    """A clock's mean progress once all workers have reported it: the count of reports closes it, not the time. A report of
    a closed clock and a worker's second report of a clock are dropped. State is a row for each clock: the workers seen and
    their sum while it is open, then a flag, which stays."""
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        closed, seen, total = state.get if state.exists else (False, [], 0.0)
        seen = list(seen)
        for rows in batches:
            for worker, progress in zip(rows["worker"].tolist(), rows["progress"].tolist(), strict=True):
                if not closed and worker not in seen:
                    seen.append(worker)
                    total += progress
        if not closed and len(seen) == workers:
            state.update((True, [], 0.0))
            yield pd.DataFrame({"branch": [key[0]], "clock": [key[1]], "progress": [total / workers]})
        else:
            state.update((closed, [] if closed else seen, total))

    return reports.groupBy("branch", "clock").applyInPandasWithState(
        step, "branch int, clock long, progress double", "closed boolean, seen array<int>, total double", "append", "NoTimeout")


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Tumbling event-time windows with a watermark. A platform capability; the batch form gives the same rows. ``ts`` may
    be without a time zone; it is then taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, late: str = "10 minutes", width: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Overlapping event-time windows by event type; an event counts in each window that holds it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """A user's events that follow one another within the gap, as one row with the first and the last time."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).select("user_id", "first", "last", "n")
