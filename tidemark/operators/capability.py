"""Process capability and sigma level: one aggregation in Spark, the normal curve on the driver."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lay_out
from ..functions.stats import normal_cdf, normal_ppf, normal_sf


@dataclass
class Capability:
    n: int
    mean: float
    sigma_within: float
    sigma_overall: float
    lsl: float | None
    usl: float | None
    target: float | None
    cp: float | None
    cpk: float
    pp: float | None
    ppk: float
    cpm: float | None
    expected_defective: float
    observed_defective: float
    dpmo: float
    sigma_level: float
    notes: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {k: round(v, 2 if k == "dpmo" else 6) if isinstance(v, float) else v for k, v in asdict(self).items()}

    def to_text(self) -> str:
        return "\n".join(f"{k:<20} {v}" for k, v in self.to_dict().items())


def sigma_level(dpmo: float) -> float:
    """Short-term sigma level with the 1.5 shift, at most 7.5."""
    if not 0 <= dpmo <= 1_000_000:
        raise ValueError("DPMO must lie between 0 and one million")
    p = dpmo / 1e6
    if p <= 0:
        return 7.5
    return 0.0 if p >= 1 else min(-normal_ppf(p), 6.0) + 1.5


def core(df: DataFrame, value: str, order: list, lsl: float | None, usl: float | None) -> DataFrame:
    """One row: n, mean, sigma_within (mean moving range in order over 1.128), sigma_overall, observed share outside.

    Moving ranges are taken in blocks of the order (its first column tells rows apart), each with the last
    row of the block before."""
    v = F.col(value).cast("double")
    d = df.select(F.col(order[0]).alias("_o"), v.alias("v"))
    d = lay_out(d, "_o", keep=False).over(1, lambda x, w: x.withColumn("mr", F.abs(F.col("v") - F.lag("v").over(w)))).plain()
    out = F.lit(False)
    if lsl is not None:
        out = out | (F.col("v") < lsl)
    if usl is not None:
        out = out | (F.col("v") > usl)
    return d.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.avg("mr") / 1.128).alias("sigma_within"), F.stddev_samp("v").alias("sigma_overall"), F.avg(out.cast("double")).alias("observed"))


def capability(df: DataFrame, value: str, order: list, lsl: float | None = None, usl: float | None = None, target: float | None = None) -> Capability:
    if lsl is None and usl is None:
        raise ValueError("at least one specification limit is needed")
    if lsl is not None and usl is not None and lsl >= usl:
        raise ValueError("the lower limit must lie below the upper")
    r = core(df, value, order, lsl, usl).first()
    if r.n < 2:
        raise ValueError("capability needs at least two values")
    if not r.sigma_within or not r.sigma_overall:
        raise ValueError("the values do not vary")

    def pair(s):
        sides = [x for x in ((usl - r.mean) / (3 * s) if usl is not None else None, (r.mean - lsl) / (3 * s) if lsl is not None else None) if x is not None]
        return (usl - lsl) / (6 * s) if len(sides) == 2 else None, min(sides)

    cp, cpk = pair(r.sigma_within)
    pp, ppk = pair(r.sigma_overall)
    cpm = None
    if target is not None and lsl is not None and usl is not None:
        cpm = (usl - lsl) / (6 * (r.sigma_overall**2 + (r.mean - target) ** 2) ** 0.5)
    expected = (normal_sf((usl - r.mean) / r.sigma_overall) if usl is not None else 0.0) + (normal_cdf((lsl - r.mean) / r.sigma_overall) if lsl is not None else 0.0)
    notes = []
    if lsl is None or usl is None:
        notes.append("one-sided specification: Cp and Pp are not defined")
    if r.sigma_overall / r.sigma_within > 1.3:
        notes.append("overall spread well above short-term spread: the process drifts, so Ppk describes it better than Cpk")
    if abs(r.observed - expected) > max(0.05, 0.5 * expected):
        notes.append("observed and expected defect rates disagree: the values are not normal")
    return Capability(r.n, r.mean, r.sigma_within, r.sigma_overall, lsl, usl, target, cp, cpk, pp, ppk, cpm, expected, r.observed, expected * 1e6, sigma_level(min(1e6, expected * 1e6)), notes)
