"""Events and cases as DataFrames.

events: case_id, activity, ts (TIMESTAMP_NTZ), resource, seq (a tie-break that makes (ts, seq) total in a
case), and any attribute columns. cases: case_id, arrived, duration_hours, resolved, sla_hours, and any
attribute columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.worktime import WorkCalendar, iso_week

EVENT_CORE = ("case_id", "activity", "ts", "resource", "seq")
CASE_CORE = ("case_id", "arrived", "duration_hours", "resolved", "sla_hours")


def in_case() -> Window:
    return Window.partitionBy("case_id").orderBy("ts", "seq")


def ordered(events: DataFrame) -> DataFrame:
    """Events with their position and neighbours in the case: one shuffle and sort that all miners share."""
    w = in_case()
    return events.withColumns({
        "pos": F.row_number().over(w),
        "next_activity": F.lead("activity").over(w),
        "next_ts": F.lead("ts").over(w),
        "next_resource": F.lead("resource").over(w),
        "prev_activity": F.lag("activity").over(w),
        "prev_ts": F.lag("ts").over(w),
    })


def wall_hours(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 3.6e9


def sort_log(events: DataFrame) -> DataFrame:
    return events.orderBy("ts", "case_id", "seq")


def add_events(events: DataFrame, more: DataFrame) -> DataFrame:
    return events.unionByName(more, allowMissingColumns=True)


def traces(events: DataFrame) -> DataFrame:
    """case_id, trace: the activities of each case in order."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "seq", "activity")))
    return events.groupBy("case_id").agg(F.transform(steps, lambda x: x["activity"]).alias("trace"))


def activities(events: DataFrame) -> DataFrame:
    return events.select("activity").distinct().orderBy("activity")


def resources(events: DataFrame) -> DataFrame:
    return events.where("resource <> ''").select("resource").distinct().orderBy("resource")


def filter_cases(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select("case_id").distinct(), "case_id", "left_semi")


def resolved_cases(cases: DataFrame) -> DataFrame:
    return cases.where("resolved")


def get_case(cases: DataFrame, case_id: str) -> DataFrame:
    return cases.where(F.col("case_id") == case_id).limit(1)


def breached() -> Column:
    """True past the target, false when resolved within it, null while open within it."""
    return F.when(F.col("duration_hours") > F.col("sla_hours"), F.lit(True)).when(F.col("resolved"), F.lit(False))


def censoring_rate(cases: DataFrame) -> DataFrame:
    return cases.agg(F.avg(F.when(F.col("resolved"), 0.0).otherwise(1.0)).alias("censoring_rate"))


def completion_date(calendar: WorkCalendar | None = None) -> Column:
    return (calendar or WorkCalendar()).add_hours("arrived", F.col("duration_hours")).cast("date")


def weekly_breaches(cases: DataFrame, calendar: WorkCalendar | None = None) -> DataFrame:
    """week, resolved, breaches, mean_hours by ISO week of completion, resolved cases only."""
    done = cases.where("resolved").withColumn("week", iso_week(completion_date(calendar)))
    return done.groupBy("week").agg(
        F.count("*").alias("resolved"),
        F.sum(F.when(breached(), 1).otherwise(0)).cast("long").alias("breaches"),
        F.avg("duration_hours").alias("mean_hours"),
    ).orderBy("week")
