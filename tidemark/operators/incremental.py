"""A log's summary that grows batch by batch: earlier batches are never read again.

ends: of each case its first and last event. steps: how often each edge took each time, in microseconds. Two
summaries merge by adding counts, and by the one step that leads over from a case's last event in the first to
its first in the second. A case's events in the second must come after those in the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .eventlog import ordered


@dataclass
class LogSummary:
    ends: DataFrame
    steps: DataFrame

    def write(self, path: str) -> None:
        self.ends.write.parquet(f"{path}/ends")
        self.steps.write.parquet(f"{path}/steps")


def read_summary(spark: SparkSession, path: str) -> LogSummary:
    return LogSummary(spark.read.parquet(f"{path}/ends"), spark.read.parquet(f"{path}/steps"))


def _micros(a, b):
    return F.timestamp_diff("MICROSECOND", a, b)


def summarize(events: DataFrame) -> LogSummary:
    """One shuffle by case."""
    o = ordered(events)
    event = F.struct("ts", "seq", "activity")
    ends = events.groupBy("case_id").agg(F.min(event).alias("first"), F.max(event).alias("last"), F.count("*").alias("events"))
    steps = o.where("next_ts IS NOT NULL").groupBy(F.col("activity").alias("source"), F.col("next_activity").alias("target"), _micros("ts", "next_ts").alias("micros")).agg(F.count("*").alias("n"))
    return LogSummary(ends, steps)


def merge(a: LogSummary, b: LogSummary) -> LogSummary:
    """The summary of both batches; raises where a case of b has an event before a's last of that case."""
    x = a.ends.select("case_id", F.col("first").alias("_f"), F.col("last").alias("_l"), F.col("events").alias("_n"))
    both = x.join(b.ends, "case_id", "full")
    ends = both.select("case_id", F.coalesce("_f", "first").alias("first"), F.coalesce("last", "_l").alias("last"), (F.coalesce("_n", F.lit(0)) + F.coalesce("events", F.lit(0))).alias("events"))
    over = x.join(b.ends, "case_id")
    late = F.raise_error(F.concat(F.lit("events of the second batch come before the first's in case "), F.col("case_id").cast("string"))).cast("long")
    takes = F.when(F.struct("_l.ts", "_l.seq") < F.struct("first.ts", "first.seq"), _micros("_l.ts", "first.ts")).otherwise(late)
    bridge = over.select(F.col("_l.activity").alias("source"), F.col("first.activity").alias("target"), takes.alias("micros"), F.lit(1).cast("long").alias("n"))
    steps = a.steps.unionByName(b.steps).unionByName(bridge).groupBy("source", "target", "micros").agg(F.sum("n").alias("n"))
    return LogSummary(ends, steps)


def graph(s: LogSummary) -> DataFrame:
    """The edges of all batches, as mining.edges gives them in elapsed hours."""
    hours = F.col("micros") / 3.6e9
    return s.steps.groupBy("source", "target").agg(
        F.sum("n").alias("frequency"), F.sum(hours * F.col("n")).alias("total_hours"), (F.sum(hours * F.col("n")) / F.sum("n")).alias("mean_hours"),
        F.percentile(hours, 0.5, F.col("n")).alias("median_hours"), F.percentile(hours, 0.9, F.col("n")).alias("p90_hours"),
    )


def start_end(s: LogSummary) -> DataFrame:
    """activity, starts, ends."""
    marks = s.ends.select(F.col("first.activity").alias("activity"), F.lit(1).alias("starts"), F.lit(0).alias("ends")).union(s.ends.select("last.activity", F.lit(0), F.lit(1)))
    return marks.groupBy("activity").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
