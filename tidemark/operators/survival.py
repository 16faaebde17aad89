"""Right-censored survival: everything runs on the risk table, one row a distinct duration.

The data-sized step is one grouped count with map-side combining. Suffix and prefix sums then run over
distinct durations, laid out in order once (functions.ordered): in one block where they are few, else in
ranges of even size, with the totals of the ranges before added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Layout, cumulative, lay_out
from ..functions.stats import chi2_sf, chi2_sf_column
from ..plans.workers import reachable

Z95 = 1.959963984540054


def check(obs: DataFrame, duration: str = "duration", event: str = "event") -> None:
    n, low, bad = obs.agg(F.count("*"), F.min(duration), F.max(F.when(F.col(event).isin(0, 1) & F.col(duration).isNotNull(), 0).otherwise(1))).first()
    if not n:
        raise ValueError("survival analysis needs observations")
    if bad or low < 0:
        raise ValueError("durations must be non-negative and events 0 or 1")


def _risk(obs: DataFrame, duration: str, event: str, rows: int | None = None) -> Layout:
    g = obs.groupBy(F.col(duration).cast("double").alias("time")).agg(F.sum(F.col(event).cast("long")).alias("events"), F.count("*").alias("n"))
    at = lay_out(g, "time", rows).running({"at_risk": F.col("n")}, descending=True)
    return at.having(at.frame.select("_blk", "time", "at_risk", "events", (F.col("n") - F.col("events")).alias("censored")))


def risk_table(obs: DataFrame, duration: str = "duration", event: str = "event", rows: int | None = None) -> DataFrame:
    """time, at_risk, events, censored by distinct duration; rows: of a block of durations."""
    return _risk(obs, duration, event, rows).plain()


def kaplan_meier(obs: DataFrame, duration: str = "duration", event: str = "event", z: float = Z95) -> DataFrame:
    """The risk table with survival, Greenwood's std_error, and log-log limits lower and upper.

    The product is F.product: exact zeros stay zeros, and steps equal the textbook product."""
    n, d = F.col("at_risk"), F.col("events")
    greenwood = F.when(n > d, d / (n * (n - d))).otherwise(0.0)
    t = _risk(obs, duration, event).running({"_g": greenwood}, products={"survival": 1.0 - d / n}).plain()
    t = t.withColumn("_g", F.when(F.col("survival") == 0, F.lit(float("inf"))).otherwise(F.col("_g")))
    s, g = F.col("survival"), F.col("_g")
    inside = (s > 0) & (s < 1) & (g < float("inf"))
    spread = F.when(inside, F.lit(z) * F.sqrt(g) / F.abs(F.ln(F.when(inside, s).otherwise(0.5))))
    t = t.withColumns({
        "std_error": F.when(g < float("inf"), s * F.sqrt(g)).otherwise(0.0),
        "lower": F.when(inside, F.pow(s, F.exp(spread))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))),
        "upper": F.when(inside, F.pow(s, F.exp(-spread))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))),
    })
    return t.drop("_g")


def survival_at(curve: DataFrame, time: float) -> float:
    """Right-continuous step; 1 before the first time."""
    r = curve.where(F.col("time") <= time).agg(F.max_by("survival", "time")).first()[0]
    return 1.0 if r is None else r


def quantile(curve: DataFrame, p: float = 0.5) -> float | None:
    """First time at which survival is at most 1 - p; None if it never is."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    return curve.where(F.col("survival") <= 1 - p).agg(F.min("time")).first()[0]


def restricted_mean(curve: DataFrame, horizon: float) -> DataFrame:
    """One row, rmst: the area under the curve up to the horizon."""
    if horizon <= 0:
        raise ValueError("the horizon must be positive")
    # h less each step's drop times what it is away from h; a last step to zero drops what the others left
    h, n, d = F.lit(float(horizon)), F.col("at_risk"), F.col("events")
    drop, away = F.when(n > d, F.col("survival") * d / (n - d)).otherwise(0.0), F.greatest(F.lit(0.0), h - F.col("time"))
    ends = F.max(F.when((n == d) & (d > 0), away))
    return curve.agg((h - F.coalesce(F.sum(drop * away), F.lit(0.0)) - F.coalesce(ends * (1 - F.sum(drop)), F.lit(0.0))).alias("rmst"))


def curve_rows(curve: DataFrame) -> DataFrame:
    """The steps of a curve for display, rounded, in order of time."""
    return curve.select(F.round("time", 4).alias("time"), "at_risk", "events", *[F.round(c, 6).alias(c) for c in ("survival", "std_error", "lower", "upper")]).orderBy("time")


def nelson_aalen(obs: DataFrame, duration: str = "duration", event: str = "event") -> DataFrame:
    return _risk(obs, duration, event).running({"cumulative_hazard": F.col("events") / F.col("at_risk")}).plain()


def hazard_at(curve: DataFrame, time: float) -> float:
    r = curve.where(F.col("time") <= time).agg(F.max_by("cumulative_hazard", "time")).first()[0]
    return 0.0 if r is None else r


def logrank_core(obs: DataFrame, group: str, duration: str = "duration", event: str = "event") -> DataFrame:
    """One row: events observed and expected in the second group, and the hypergeometric variance.

    group: 0 or 1. At-risk counts of both groups come from one pooled table by suffix sums."""
    g = F.col(group).cast("int")
    t = obs.groupBy(F.col(duration).cast("double").alias("time")).agg(
        F.count("*").alias("n"), F.sum(g).cast("long").alias("n1"), F.sum(F.col(event).cast("long")).alias("d"), F.sum(F.col(event).cast("long") * g).alias("d1"),
    )
    t = cumulative(t, "time", {"r": F.col("n"), "r1": F.col("n1")}, descending=True).where("d > 0 AND r > 1")
    r, r1, d = F.col("r").cast("double"), F.col("r1"), F.col("d")
    return t.agg(F.sum("d1").cast("double").alias("observed"), F.sum(d * r1 / r).alias("expected"), F.sum(d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1)).alias("variance"))


def logrank_by(obs: DataFrame, by: str, group: str, duration: str = "duration", event: str = "event", rows: int | None = None) -> DataFrame:
    """by, observed, expected, variance, statistic, p_value: one log-rank test in each stratum of `by`, in one job.

    All strata share one layout of (stratum, duration), so a stratum of any size lies over several ranges."""
    reachable(obs.sparkSession)
    g = F.col(group).cast("int")
    t = obs.groupBy(F.col(by).alias("by"), F.col(duration).cast("double").alias("time")).agg(
        F.count("*").alias("n"), F.sum(g).cast("long").alias("n1"), F.sum(F.col(event).cast("long")).alias("d"), F.sum(F.col(event).cast("long") * g).alias("d1"),
    ).withColumn("_o", F.struct("by", "time"))
    at = lay_out(t, "_o", rows).running({"_r": F.col("n"), "_r1": F.col("n1")}, descending=True).plain()
    # what strata after this one add to its running sums
    after = at.groupBy(F.col("by").alias("_by")).agg(F.min(F.col("_r") - F.col("n")).alias("_a"), F.min(F.col("_r1") - F.col("n1")).alias("_a1"))
    at = at.join(after, F.col("by").eqNullSafe(F.col("_by"))).withColumns({"r": (F.col("_r") - F.col("_a")).cast("double"), "r1": F.col("_r1") - F.col("_a1")})
    r, r1, d, open_ = F.col("r"), F.col("r1"), F.col("d"), (F.col("d") > 0) & (F.col("r") > 1)
    own = lambda x: F.coalesce(F.sum(F.when(open_, x)), F.lit(0.0))
    got = at.groupBy("by").agg(own(F.col("d1").cast("double")).alias("observed"), own(d * r1 / r).alias("expected"), own(d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1)).alias("variance"))
    got = got.withColumn("statistic", F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance")).otherwise(0.0))
    return got.withColumn("p_value", chi2_sf_column("statistic", 1)).withColumnRenamed("by", by)


@dataclass
class LogRank:
    statistic: float
    p_value: float
    observed: tuple[float, float]
    expected: tuple[float, float]


def logrank(obs: DataFrame, group: str, duration: str = "duration", event: str = "event") -> LogRank:
    check(obs, duration, event)
    r = logrank_core(obs, group, duration, event).first()
    total, second = obs.agg(F.sum(F.col(event).cast("double")), F.sum(F.col(event).cast("double") * F.col(group))).first()
    o, e, v = r.observed or 0.0, r.expected or 0.0, r.variance or 0.0
    stat = (o - e) ** 2 / v if v > 0 else 0.0
    return LogRank(stat, chi2_sf(stat, 1) if v > 0 else 1.0, (total - second, second), (total - e, e))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """The element at position n div 2 (from 0) of the sorted values: not interpolated."""
    n = df.agg(F.count(value).alias("_n"))
    d = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    d = cumulative(d, "v", {"_to": F.col("k")})
    return d.join(F.broadcast(n), F.expr("_to > _n div 2")).agg(F.min("v").alias("upper_median"))


def thin(curve: DataFrame, order: str, budget: int = 300) -> DataFrame:
    """Every stride-th row and the last, for display."""
    at = lay_out(curve, order)
    n = at.frame.count()
    stride = max(1, n // budget)
    return at.running({"_i": F.lit(1)}).plain().withColumn("_i", F.col("_i") - 1).where((F.col("_i") % stride == 0) | (F.col("_i") == n - 1)).drop("_i")
