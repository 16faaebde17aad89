"""Exact quantiles of groups of any size by refining ranges over grouped counts.

`percentile` keeps all distinct values of a group in one buffer. Here each round cuts the range of values that may
hold a group's quantile into `buckets` (of even width, or by magnitude) and counts the rows in each, with map-side combining: a group
is a bounded number of counts, wherever its rows are. The bucket that holds the wanted ranks, narrowed to its least
and greatest value, is the next round's range. Once it holds at most `limit` rows, or a single value, its distinct
values are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop

#: Rows for which one buffer a group is small enough.
SMALL = 1_000_000


def _size(c: str) -> Column:
    """A number that rises with the column, by one a doubling."""
    return F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log2(F.abs(F.col(c))) + 1100))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], limit: int = 100_000, buckets: int = 1024) -> DataFrame:
    """keys, q0, q1...: linearly interpolated quantiles (type 7) of the non-null values; groups without any are left out."""
    keys, at, own = list(keys), [f"_k{i}" for i in range(len(keys))], [f"_r{i}" for i in range(len(keys))]
    rows = cut(df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(r) for k, r in zip(keys, own)], F.col(value).cast("double").alias("_v")))
    groups = rows.groupBy(*[F.col(r).alias(a) for r, a in zip(own, at)]).agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # one wanted rank a row: the one at or below the quantile's place, weighing 1 - part, and the one at or above, weighing part
    place = F.col("_q") * (F.col("_in") - 1)
    state = groups.select("*", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("_i", "_q")).withColumn("_part", place - F.floor(place))
    sides = F.array(F.struct(F.floor(place).alias("_rank"), (1 - F.col("_part")).alias("_share")), F.struct(F.ceil(place).alias("_rank"), F.col("_part").alias("_share")))
    state = cut(state.select(*at, "_i", F.explode(sides).alias("_s"), "_in", "_lo", "_hi", F.lit(0).cast("long").alias("_under")).select(*at, "_i", "_s.*", "_in", "_lo", "_hi", "_under").where("_share > 0"))

    def inside(s: DataFrame) -> DataFrame:
        test = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        for r, a in zip(own, at):
            test = test & F.col(r).eqNullSafe(F.col(a))
        return rows.join(s, test).select(*s.columns, "_v")

    wide = (F.col("_in") > limit) & (F.col("_lo") < F.col("_hi"))
    while not state.where(wide).isEmpty():
        # by magnitude while the range spans more than a doubling, then evenly: some rounds do for any doubles
        even = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        step = F.when(_size("_hi") - _size("_lo") > 1, (_size("_v") - _size("_lo")) / (_size("_hi") - _size("_lo"))).otherwise(even)
        d = inside(state.where(wide)).withColumn("_b", F.least(F.floor(step * buckets), F.lit(buckets - 1)))
        own_rank = [*at, "_i", "_rank", "_share"]
        counts = d.groupBy(*own_rank, "_under", "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        w = Window.partitionBy(*own_rank).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.col("_under") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
        # the least and the greatest value lie in different buckets, so the one that holds the rank is smaller
        hit = counts.where((F.col("_before") <= F.col("_rank")) & (F.col("_before") + F.col("_n") > F.col("_rank")))
        narrow = hit.select(*own_rank, F.col("_n").alias("_in"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_before").alias("_under"))
        old, state = state, cut(state.where(~wide).unionByName(narrow))
        drop(old)
    sure = state.where(F.col("_lo") == F.col("_hi")).select(*at, "_i", "_share", F.col("_lo").alias("_x"))
    d = inside(state.where(F.col("_lo") < F.col("_hi"))).groupBy(*at, "_i", "_rank", "_share", "_under", "_v").agg(F.count("*").alias("_n"))
    d = d.withColumn("_upto", F.col("_under") + F.sum("_n").over(Window.partitionBy(*at, "_i", "_rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = d.where(F.col("_upto") > F.col("_rank")).groupBy(*at, "_i", "_rank", "_share").agg(F.min("_v").alias("_x")).select(*at, "_i", "_share", "_x")
    whole = sure.union(found).groupBy(*at, "_i").agg(F.sum(F.col("_share") * F.col("_x")).alias("_x"))
    out = cut(whole.groupBy(*at).agg(*[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(f"q{i}") for i in range(len(qs))]))
    drop(rows), drop(state)
    return out.withColumnsRenamed(dict(zip(at, keys)))
