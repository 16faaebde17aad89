"""Shewhart control charts as windows over an ordered series (one row a subgroup or period).

A chart has index, label, value, center, lcl, ucl, sigma, z, violations. Centres and limits come from one
aggregate row; neighbours, numbers and run rules share one layout of the points in order, which reads them
once and may be as long as the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Layout, lay_out
from .nelson import RULES, flags

# Control-chart constants for subgroups of 2 to 10.
D2 = {2: 1.128, 3: 1.693, 4: 2.059, 5: 2.326, 6: 2.534, 7: 2.704, 8: 2.847, 9: 2.970, 10: 3.078}
D3_CONST = {2: 0.853, 3: 0.888, 4: 0.880, 5: 0.864, 6: 0.848, 7: 0.833, 8: 0.820, 9: 0.808, 10: 0.797}
A2 = {2: 1.880, 3: 1.023, 4: 0.729, 5: 0.577, 6: 0.483, 7: 0.419, 8: 0.373, 9: 0.337, 10: 0.308}
D3 = {2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.076, 8: 0.136, 9: 0.184, 10: 0.223}
D4 = {2: 3.267, 3: 2.574, 4: 2.282, 5: 2.114, 6: 2.004, 7: 1.924, 8: 1.864, 9: 1.816, 10: 1.777}




def _need(df: DataFrame, least: int, bad: Column | None = None, message: str = "invalid input", *more: Column):
    """Check the series, and return the aggregates in `more`, of the same pass."""
    n, wrong, *got = df.agg(F.count("*"), F.coalesce(F.max(bad.cast("int")) if bad is not None else F.lit(0), F.lit(0)), *more).first()
    if n < least:
        raise ValueError(f"a chart needs at least {least} points")
    if wrong:
        raise ValueError(message)
    return [F.lit(None if x is None else float(x)).cast("double") for x in got]


def _points(df: DataFrame, order: str, label: str | None, **columns: Column) -> tuple[Layout, str | None]:
    """The series laid out by _o, with the given columns and the label's, and where the label is."""
    d = df.select(F.col(order).alias("_o"), *([label] if label and label != order else []), *[c.cast("double").alias(k) for k, c in columns.items()])
    return lay_out(d, "_o"), "_o" if label == order else label


def _ranges(at: Layout, value: str, out: str) -> Layout:
    """Moving ranges of two along the order."""
    return at.over(1, lambda x, w: x.withColumn(out, F.abs(F.col(value) - F.lag(value).over(w))))


def _finish(at: Layout, points: DataFrame, rules: Sequence[int] | None, label: str | None) -> DataFrame:
    """points: rows of the layout with value, center, lcl, ucl, sigma. Adds index, label, z and violations."""
    p = at.having(points.withColumn("z", F.when(F.col("sigma") > 0, (F.col("value") - F.col("center")) / F.col("sigma")).otherwise(0.0))).numbered("index")
    p = flags(p.having(p.frame.withColumn("label", F.col(label).cast("string") if label else F.col("index").cast("string"))), "z", "_o", rules)
    return p.select("index", "label", "value", "center", "lcl", "ucl", "sigma", "z", "violations")


def individuals(df: DataFrame, value: str, order: str, label: str | None = None, rules=None) -> DataFrame:
    """X chart: sigma is the mean moving range over 1.128."""
    at, label = _points(df, order, label, value=F.col(value))
    center, mr = _need(_ranges(at, "value", "_mr").frame, 2, None, "", F.avg("value"), F.avg("_mr"))
    d = at.frame.withColumns({"center": center, "sigma": mr / D2[2]})
    return _finish(at, d.withColumns({"lcl": F.col("center") - 3 * F.col("sigma"), "ucl": F.col("center") + 3 * F.col("sigma")}), rules, label)


def moving_range(df: DataFrame, value: str, order: str, label: str | None = None) -> DataFrame:
    """Chart of the moving ranges; only rule 1; a range has the label of its later point."""
    at, label = _points(df, order, label, _v=F.col(value))
    _need(at.frame, 2)
    d = _ranges(at, "_v", "value").frame.where("value IS NOT NULL")
    d = d.withColumn("center", *_need(d, 1, None, "", F.avg("value")))
    d = d.withColumns({"ucl": D4[2] * F.col("center"), "lcl": F.greatest(F.lit(0.0), D3[2] * F.col("center")), "sigma": F.col("center") * D3_CONST[2] / D2[2]})
    return _finish(at, d, [1], label)


def xbar_r(df: DataFrame, value: str, subgroup: str, rules=None) -> DataFrame:
    """Means of equal subgroups of 2 to 10; limits by A2 and the mean range."""
    g = df.groupBy(F.col(subgroup).alias("_o")).agg(F.avg(value).alias("value"), (F.max(value) - F.min(value)).alias("range"), F.count("*").alias("_n"))
    at = lay_out(g, "_o")
    low, high, center, mean_range, n = at.frame.agg(F.min("_n"), F.max("_n"), F.avg("value"), F.avg("range"), F.count("*")).first()
    if low is None or low != high or low not in D2:
        raise ValueError("subgroups must all have one size from 2 to 10")
    if n < 2:
        raise ValueError("a chart needs at least 2 points")
    g = at.frame.withColumns({"center": F.lit(center), "_r": F.lit(mean_range)})
    g = g.withColumns({"ucl": F.col("center") + A2[low] * F.col("_r"), "lcl": F.col("center") - A2[low] * F.col("_r"), "sigma": F.col("_r") / D2[low] / float(low) ** 0.5})
    return _finish(at, g, rules, "_o")


def p_chart(df: DataFrame, count: str, size: str, order: str, label: str | None = None, rules=None) -> DataFrame:
    """Proportions with limits by each point's size, clipped to [0, 1]."""
    at, label = _points(df, order, label, _c=F.col(count), _n=F.col(size))
    c, n = F.col("_c"), F.col("_n")
    total, base = _need(at.frame, 2, (n <= 0) | (c < 0) | (c > n), "counts must lie in 0..size and sizes be positive", F.sum(c), F.sum(n))
    d = at.frame.withColumns({"value": c / n, "center": total / base})
    d = d.withColumn("sigma", F.sqrt(F.col("center") * (1 - F.col("center")) / n))
    return _finish(at, d.withColumns({"lcl": F.greatest(F.lit(0.0), F.col("center") - 3 * F.col("sigma")), "ucl": F.least(F.lit(1.0), F.col("center") + 3 * F.col("sigma"))}), rules, label)


def p_chart_is_weak(df: DataFrame, count: str, size: str) -> bool:
    """True when the normal approximation is poor: smallest size times pooled proportion under 5."""
    low, total, n = df.agg(F.min(size), F.sum(count), F.sum(size)).first()
    return low * total / n < 5


def c_chart(df: DataFrame, count: str, order: str, label: str | None = None, rules=None) -> DataFrame:
    at, label = _points(df, order, label, value=F.col(count))
    center = _need(at.frame, 2, F.col("value") < 0, "counts must not be negative", F.avg("value"))[0]
    d = at.frame.withColumn("center", center).withColumn("sigma", F.sqrt("center"))
    return _finish(at, d.withColumns({"lcl": F.greatest(F.lit(0.0), F.col("center") - 3 * F.col("sigma")), "ucl": F.col("center") + 3 * F.col("sigma")}), rules, label)


def u_chart(df: DataFrame, count: str, exposure: str, order: str, label: str | None = None, rules=None) -> DataFrame:
    at, label = _points(df, order, label, _c=F.col(count), _e=F.col(exposure))
    c, e = F.col("_c"), F.col("_e")
    total, base = _need(at.frame, 2, (c < 0) | (e <= 0), "counts must not be negative and exposures be positive", F.sum(c), F.sum(e))
    d = at.frame.withColumns({"value": c / e, "center": total / base})
    d = d.withColumn("sigma", F.sqrt(F.col("center") / e))
    return _finish(at, d.withColumns({"lcl": F.greatest(F.lit(0.0), F.col("center") - 3 * F.col("sigma")), "ucl": F.col("center") + 3 * F.col("sigma")}), rules, label)


def signals(chart: DataFrame) -> DataFrame:
    """Points that broke a rule, with the rules joined by a bar."""
    return chart.where(F.size("violations") > 0).withColumn("violations", F.concat_ws("|", "violations"))


def in_control(chart: DataFrame) -> bool:
    return signals(chart).limit(1).count() == 0


def to_rows(chart: DataFrame) -> DataFrame:
    got = chart.select("index", "label", *[F.round(c, 6).alias(c) for c in ("value", "center", "lcl", "ucl", "sigma", "z")], F.concat_ws("|", "violations").alias("violations"))
    return got.orderBy("index")


def to_text(chart: DataFrame, title: str = "", points: int = 60, width: int = 49) -> str:
    """The last `points` points, one a line: a plot between the limits, and the rules that a point broke."""
    rows = chart.orderBy(F.col("index").desc()).limit(points).collect()[::-1]
    if not rows:
        return title
    low, high = (f(x for r in rows for x in (r.value, r.lcl, r.ucl)) for f in (min, max))
    place = lambda x: round((width - 1) * (x - low) / ((high - low) or 1.0))
    out = [title] if title else []
    out.append(f"centre {rows[-1].center:.4f}, limits {rows[-1].lcl:.4f} to {rows[-1].ucl:.4f}, {sum(bool(r.violations) for r in rows)} of {len(rows)} points with a signal")
    for r in rows:
        line = [" "] * width
        for x, mark in ((r.lcl, "|"), (r.ucl, "|"), (r.center, ":"), (r.value, "X" if r.violations else "o")):
            line[place(x)] = mark
        out.append(f"{r.label[-14:]:>14} {''.join(line)} {r.value:12.4f} {' '.join(r.violations)}".rstrip())
    return "\n".join(out)


__all__ = ["RULES", "c_chart", "in_control", "individuals", "moving_range", "p_chart", "p_chart_is_weak", "signals", "to_rows", "to_text", "u_chart", "xbar_r"]
