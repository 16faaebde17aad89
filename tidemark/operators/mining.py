"""Process mining over the ordered event frame (see eventlog.ordered)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantiles
from ..functions.ordered import lay_out
from ..functions.shared import cut
from ..functions.worktime import WorkCalendar
from .eventlog import ordered, traces, wall_hours


def _with_quantiles(events: DataFrame, rows: DataFrame, keys: list[str], aggregates: list[Column], small: int | None, exact: bool) -> DataFrame:
    """Groups of rows with aggregates, and median_hours and p90_hours of the column hours (type 7).

    Exact by one buffer a group where there are at most `small` events (no more rows come of them), by selection
    over grouped counts beyond; exact=False: a sketch."""
    qs, names = (0.5, 0.9), ("median_hours", "p90_hours")
    small = quantiles.SMALL if small is None else small
    if not exact:
        return rows.groupBy(*keys).agg(*aggregates, *[F.percentile_approx("hours", q, 100_000).alias(n) for q, n in zip(qs, names)])
    if small and events.count() <= small:
        return rows.groupBy(*keys).agg(*aggregates, *[F.percentile("hours", q).alias(n) for q, n in zip(qs, names)])
    rows = cut(rows)
    got = quantiles.exact_quantiles(rows, keys, "hours", qs).withColumnsRenamed({"q0": names[0], "q1": names[1]})
    return rows.groupBy(*keys).agg(*aggregates).join(got, keys, "left")


def nodes(events: DataFrame) -> DataFrame:
    """activity, frequency, case_frequency, repetition_rate.

    Two levels, so that a distinct count per activity never gathers case ids: (activity, case) first."""
    per = events.groupBy("activity", "case_id").agg(F.count("*").alias("n"))
    got = per.groupBy("activity").agg(F.sum("n").alias("frequency"), F.count("*").alias("case_frequency"))
    return got.withColumn("repetition_rate", F.try_divide(F.col("frequency"), F.col("case_frequency")))


def steps(events: DataFrame, calendar: WorkCalendar | None = None) -> DataFrame:
    """source, target, hours of each pair of consecutive events of a case."""
    hours = calendar.hours_between("ts", "next_ts") if calendar else wall_hours("ts", "next_ts")
    return ordered(events).where("next_activity IS NOT NULL").select(F.col("activity").alias("source"), F.col("next_activity").alias("target"), hours.alias("hours"))


def edges(events: DataFrame, calendar: WorkCalendar | None = None, least: int = 1, exact: bool = True, small: int | None = None) -> DataFrame:
    """Directly-follows edges: frequency, total, mean, median and p90 hours; at least `least` times."""
    stats = [F.count("*").alias("frequency"), F.sum("hours").alias("total_hours"), F.avg("hours").alias("mean_hours")]
    got = _with_quantiles(events, steps(events, calendar), ["source", "target"], stats, small, exact)
    return got.where(F.col("frequency") >= least) if least > 1 else got


def start_end(events: DataFrame) -> DataFrame:
    """activity, starts, ends: how many cases start and end with it."""
    o = ordered(events).where("pos = 1 OR next_activity IS NULL")
    return o.groupBy("activity").agg(F.sum(F.when(F.col("pos") == 1, 1).otherwise(0)).alias("starts"), F.sum(F.when(F.col("next_activity").isNull(), 1).otherwise(0)).alias("ends"))


def successors(edge_frame: DataFrame, activity: str) -> DataFrame:
    return edge_frame.where(F.col("source") == activity).select("target").orderBy("target")


def self_loops(edge_frame: DataFrame) -> DataFrame:
    return edge_frame.where("source = target")


def bottlenecks(events: DataFrame | None, calendar: WorkCalendar | None = None, top: int = 10, graph: DataFrame | None = None) -> DataFrame:
    """The `top` edges by total hours (ties by source, target); a graph found before may be passed."""
    if graph is None:
        graph = steps(events, calendar).groupBy("source", "target").agg(F.count("*").alias("frequency"), F.sum("hours").alias("total_hours"), F.avg("hours").alias("mean_hours"))
    return graph.select("source", "target", "total_hours", "mean_hours", "frequency").orderBy(F.col("total_hours").desc(), "source", "target").limit(top)


def variants(events: DataFrame, limit: int | None = None, with_cases: bool = False) -> DataFrame:
    """Distinct traces with count and length, most frequent first, then by trace.

    variant_cases lists who is in which; with_cases gathers the ids in one row a variant, for small logs."""
    g = traces(events).groupBy("trace")
    got = g.agg(F.count("*").alias("count"), *([F.sort_array(F.collect_list("case_id")).alias("case_ids")] if with_cases else []))
    got = got.withColumn("length", F.size("trace")).orderBy(F.col("count").desc(), "trace")
    return got.limit(limit) if limit else got


def variant_cases(events: DataFrame) -> DataFrame:
    """trace, case_id: one row a case."""
    return traces(events).select("trace", "case_id")


def variant_coverage(events: DataFrame, rows: int | None = None) -> DataFrame:
    """rank, trace, count, coverage: share of cases in this variant and the more frequent ones.

    Variants lie in ranges of (falling count, trace), cut inside equal counts and common starts alike, so very many
    variants of one case each are as any others; rows: of a range."""
    v = traces(events).groupBy("trace").agg(F.count("*").alias("count")).withColumn("_o", F.struct((-F.col("count")).alias("c"), "trace"))
    at = lay_out(v, "_o", rows).running({"rank": F.lit(1), "_upto": F.col("count")})
    total = at.frame.agg(F.sum("count")).first()[0] or 0
    return at.frame.select(F.col("rank").cast("int").alias("rank"), "trace", "count", (F.col("_upto") / float(total or 1)).alias("coverage"))


def activity_statistics(events: DataFrame, cases: DataFrame | None = None, exact: bool = True, small: int | None = None) -> DataFrame:
    """occurrences, cases and hours since the event before (for the first: since arrival, if cases are given)."""
    o = ordered(events).select("case_id", "activity", "ts", "prev_ts", "pos")
    if cases is not None:
        o = o.join(cases.select("case_id", "arrived"), "case_id", "left").withColumn("prev_ts", F.coalesce("prev_ts", F.col("arrived").cast("timestamp_ntz")))
    o = o.withColumn("hours", F.greatest(F.lit(0.0), wall_hours("prev_ts", "ts"))).withColumn("hours", F.when(F.col("prev_ts").isNotNull(), F.col("hours")))
    # a case counts once for an activity: at its first event of it
    first = F.row_number().over(Window.partitionBy("case_id", "activity").orderBy("pos")) == 1
    o = o.select("activity", "hours", first.alias("first"))
    nought = lambda c: F.coalesce(c, F.lit(0.0))
    stats = [F.count("*").alias("occurrences"), F.sum(F.col("first").cast("long")).alias("cases"), nought(F.avg("hours")).alias("mean_hours"), nought(F.sum("hours")).alias("total_hours")]
    got = _with_quantiles(events, o, ["activity"], stats, small, exact)
    got = got.withColumns({c: nought(F.col(c)) for c in ("median_hours", "p90_hours")})
    return got.select("activity", "occurrences", "cases", "mean_hours", "median_hours", "p90_hours", "total_hours").orderBy("activity")


def rework(events: DataFrame) -> DataFrame:
    """Per activity: cases with it, cases that repeat it, occurrences, immediate repeats, and the two rates."""
    o = ordered(events).groupBy("activity", "case_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("prev_activity") == F.col("activity"), 1).otherwise(0)).alias("loops"))
    got = o.groupBy("activity").agg(
        F.count("*").alias("cases"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("rework_cases"), F.sum("n").alias("occurrences"), F.sum("loops").alias("self_loops"),
    )
    return got.withColumns({"rework_rate": F.try_divide("rework_cases", "cases"), "first_time_right": 1 - F.try_divide("rework_cases", "cases")}).orderBy("activity")


def handovers(events: DataFrame, include_self: bool = False) -> DataFrame:
    """source, target, count of consecutive events' resources, blanks left out."""
    o = ordered(events).where("resource <> '' AND next_resource <> ''")
    if not include_self:
        o = o.where("resource <> next_resource")
    return o.groupBy(F.col("resource").alias("source"), F.col("next_resource").alias("target")).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "source", "target")


def map_thresholds(edge_frame: DataFrame, steps_n: int = 8) -> list[int]:
    """1 and evenly spaced order statistics of the edge frequencies (activities squared at most)."""
    f = sorted(r.frequency for r in edge_frame.select("frequency").collect())
    return sorted({1, *(f[int(i * (len(f) - 1) / (steps_n - 1))] for i in range(steps_n))}) if f else [1]
