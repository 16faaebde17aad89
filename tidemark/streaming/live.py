"""The same figures over a stream of events (an extension: batch is the reference for each).

Sources that carry TIMESTAMP_NTZ are cast once, as watermarks need TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark, path: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def timed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def period_counts(events: DataFrame, bad: str, period: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """start, n, errors by tumbling window: the points of p, c and u charts; late events beyond the delay are dropped."""
    g = timed(events, delay).groupBy(F.window("ts", period).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum(F.when(F.col("activity") == bad, 1).otherwise(0)).alias("errors")).select(F.col("w.start").alias("start"), "n", "errors")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Cases from gaps: case_id, start, end, n."""
    g = timed(events, delay).groupBy("case_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select("case_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def transitions(events: DataFrame, delay: str = "1 hour", forget_hours: float = 24.0 * 90) -> DataFrame:
    """source, target, hours as they become certain. Sum them for the graph.

    A case's state is its last event before the watermark and the events after it, which wait there, so late
    ones find their place; a case without events for forget_hours of event time is forgotten."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, last_at, waiting = None, None, []
        if state.exists:
            last, last_at, ats, seqs, names = state.get
            waiting = list(zip(ats, seqs, names))
        for pdf in batches:
            waiting += zip((t.value // 1000 for t in pdf["ts"]), pdf["seq"].tolist(), pdf["activity"].tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        rows, n = [], 0
        for at, _, activity in waiting:
            if at > mark:
                break
            if last is not None:
                rows.append((last, activity, (at - last_at) / 3.6e9))
            last, last_at, n = activity, int(at), n + 1
        waiting = waiting[n:]
        forget = (last_at or 0) // 1000 + int(forget_hours * 3.6e6)
        if state.hasTimedOut and not waiting and mark // 1000 >= forget:
            state.remove()
        else:
            state.update((last, last_at, *([int(x[0]) for x in waiting], [int(x[1]) for x in waiting], [x[2] for x in waiting])))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, int(waiting[0][0] // 1000) + 1 if waiting else forget))
        yield pd.DataFrame(rows, columns=["source", "target", "hours"])

    e = timed(events, delay).select("case_id", "activity", "ts", "seq")
    shape = "last string, last_at long, at array<long>, seq array<long>, activity array<string>"
    return e.groupBy("case_id").applyInPandasWithState(step, "source string, target string, hours double", shape, "append", GroupStateTimeout.EventTimeTimeout)
