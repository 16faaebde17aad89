"""Harrell's concordance index, exact, on blocks of even size.

Pairs (i, j) compare when i has an event and j lasted longer, or as long without an event. Durations are numbered
from the longest down and cut into slices of even size; one that fills a slice has one for itself. A pair lies

- at one duration: running sums over (duration, risk), laid out by ranges, count these;
- in one slice: each slice's cases are counted by themselves, in order of risk;
- or in two: dealt by ranges of risk, each range counts its own pairs of different slices, and for the risks
  below it one vector of cases a slice is enough, the sum of the ranges' before.

So each case moves three times, whatever the durations and risks, and no duration or risk is hot; no two cases
are matched, and the driver holds one number a slice and range. Within a task pairs are counted by running sums
over risk, bit by bit of the slice's or duration's number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lay_out
from ..functions.shared import cut, drop
from ..plans.workers import reachable

#: Cases of a slice or range, and slices at most (each range keeps a vector of so many numbers).
ROWS, SLICES = 1 << 18, 1 << 12


def _grouped(obs: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    return obs.groupBy(F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r")).agg(F.count("*").alias("n"))


def _share(got: DataFrame) -> DataFrame:
    return got.withColumn("c_index", F.when(F.col("pairs") > 0, F.col("concordant") / F.col("pairs")).otherwise(0.5))


def by_join(obs: DataFrame, duration: str = "duration", event: str = "event", risk: str = "risk") -> DataFrame:
    """One row: concordant (ties count a half), pairs, c_index, by matching all pairs: a check on small tables."""
    g = _grouped(obs, duration, event, risk)
    i = g.where("e = 1").select(F.col("t").alias("ti"), F.col("r").alias("ri"), F.col("n").alias("ni"))
    j = g.select(F.col("t").alias("tj"), F.col("e").alias("ej"), F.col("r").alias("rj"), F.col("n").alias("nj"))
    pairs = i.join(j, (F.col("tj") > F.col("ti")) | ((F.col("tj") == F.col("ti")) & (F.col("ej") == 0)))
    weight = F.col("ni") * F.col("nj")
    good = F.when(F.col("ri") > F.col("rj"), 1.0).when(F.col("ri") == F.col("rj"), 0.5).otherwise(0.0)
    return _share(pairs.agg(F.coalesce(F.sum(weight * good), F.lit(0.0)).alias("concordant"), F.coalesce(F.sum(weight), F.lit(0)).alias("pairs")))


def below(level: np.ndarray, r: np.ndarray, n: np.ndarray, short: np.ndarray) -> tuple[float, int]:
    """(concordant, pairs) of rows in order of risk r: pairs of a row with weight `short` and one of smaller level, weight n.

    Two levels part at one bit: above it they agree, and the smaller has it unset. For each bit, one running
    sum over risk within equal higher bits counts what lies below, ties of risk a half."""
    if not len(r):
        return 0.0, 0
    good, pairs = 0, 0
    for bit in range(int(level.max()).bit_length()):
        group, high = level >> (bit + 1), (level >> bit) & 1 == 1
        order = np.argsort(group, kind="stable")  # keeps the order of risk
        g, x = group[order], r[order]
        count, mine = np.where(high, 0, n)[order], np.where(high, short, 0)[order]
        upto = np.concatenate([[0], np.cumsum(count)])
        first = np.concatenate([[True], g[1:] != g[:-1]])
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        new = first | np.concatenate([[True], x[1:] != x[:-1]])
        tie = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(x))
        last = np.append(np.flatnonzero(first)[1:], len(x))[np.cumsum(first) - 1]
        lower, same, whole = upto[at][tie] - upto[start], (upto[end] - upto[at])[tie], upto[last] - upto[start]
        good += int(mine @ (2 * lower + same))
        pairs += int(mine @ whole)
    return good / 2, pairs


def _result(good: int, pairs: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([good], pa.int64()), pa.array([pairs], pa.int64())], ["twice", "pairs"])


_SHAPE = "twice long, pairs long"


def _within(t: pa.Table) -> pa.Table:
    """Pairs of one slice."""
    level, r, n, e = (np.asarray(t.column(c)) for c in ("level", "r", "n", "e"))
    order = np.argsort(r, kind="stable")
    level, r, n, e = level[order], r[order], n[order], e[order]
    good, pairs = below(np.unique(level, return_inverse=True)[1], r, n, n * e)
    return pa.Table.from_batches([_result(int(2 * good), pairs)])


def _sizes(slices: int):
    """Map: of each range of risk, its cases by slice."""

    def run(batches):
        total, part = np.zeros(slices, np.int64), None
        for b in batches:
            total += np.bincount(np.asarray(b.column(0)), weights=np.asarray(b.column(2)), minlength=slices).astype(np.int64)
            part = b.column(4)[0].as_py()
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sizes"])

    return run


def _across(slices: int, lower: dict):
    """Map: pairs of different slices whose other case lies in this range of risk or, by `lower`, in those before."""

    def run(batches):
        got = [[np.asarray(c) for c in b.columns] for b in batches]
        if not got:
            return
        cut, r, n, e, part = map(np.concatenate, zip(*got))
        order = np.argsort(r, kind="stable")
        cut, r, n, e = cut[order].astype(np.int64), r[order], n[order], e[order]
        short = n * e
        good, _ = below(cut, r, n, short)
        under = np.concatenate([[0], np.cumsum(lower[int(part[0])])])[:-1]  # in smaller slices
        yield _result(int(2 * good) + 2 * int(short @ under[cut]), 0)

    return run


def _same_duration(g: DataFrame, rows: int) -> int:
    """Twice the concordant pairs of an event and a case of the same duration without one."""
    one = g.groupBy("t", "r").agg(F.sum(F.col("n") * (1 - F.col("e"))).alias("open"), F.sum(F.col("n") * F.col("e")).alias("ended")).withColumn("_o", F.struct("t", "r"))
    at = lay_out(one, "_o", rows).running({"upto": F.col("open")}).plain()
    before = at.groupBy(F.col("t").alias("_t")).agg(F.min(F.col("upto") - F.col("open")).alias("before"))
    at = at.where("ended > 0").join(before, F.col("t") == F.col("_t"))
    return at.agg(F.sum(F.col("ended") * (2 * (F.col("upto") - F.col("open") - F.col("before")) + F.col("open")))).first()[0] or 0


def by_blocks(obs: DataFrame, duration: str = "duration", event: str = "event", risk: str = "risk", rows: int | None = None) -> DataFrame:
    """One row: concordant (ties count a half), pairs, c_index."""
    spark, rows = obs.sparkSession, rows or ROWS
    reachable(spark)
    g = cut(_grouped(obs, duration, event, risk))
    at = lay_out(g.groupBy("t").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("e")).alias("d")), "t")
    # from the longest down; an event compares with all cases so far but the events of its own duration
    at = at.running({"place": F.lit(1), "upto": F.col("size")}, descending=True)
    cases, pairs = at.frame.agg(F.sum("size"), F.sum((F.col("upto") - F.col("d")) * F.col("d"))).first()
    cases, pairs = cases or 0, pairs or 0
    each = max(rows, -(-cases // SLICES))
    if cases <= each:  # one slice, in which cases without an event come before those with one of the same duration
        d = g.join(at.frame.select(F.col("t").alias("_t"), "place"), F.col("t") == F.col("_t")).select(F.lit(1).alias("cut"), (2 * F.col("place") + F.col("e")).alias("level"), "r", "n", "e")
        twice = d.groupBy("cut").applyInArrow(_within, _SHAPE).agg(F.sum("twice")).first()[0] or 0
        drop(g)
        return _share(spark.createDataFrame([(twice / 2, int(pairs))], "concordant double, pairs long"))
    # a slice holds whole durations; of those that end in the same one, one as large as a slice comes first
    slices = 2 * (cases // each + 1)
    own = 2 * F.floor((F.col("upto") - 1) / each).cast("int") + F.when(F.col("size") >= each, 0).otherwise(1)
    times = at.frame.select(F.col("t").alias("_t"), "place", own.alias("cut"))
    d = g.join(times, F.col("t") == F.col("_t")).select("cut", F.col("place").alias("level"), "r", "n", "e")
    inside = d.where("cut % 2 = 1").groupBy("cut").applyInArrow(_within, _SHAPE)
    n = d.groupBy("cut", "r", "e").agg(F.sum("n").alias("n")).select("cut", "r", "n", "e")
    ranged = cut(n.repartitionByRange(-(-cases // rows), "r").withColumn("part", F.spark_partition_id()))
    got = {r.part: np.frombuffer(r.sizes, np.int64) for r in ranged.mapInArrow(_sizes(slices), "part int, sizes binary").collect()}
    lower, upto = {}, np.zeros(slices, np.int64)
    for part in sorted(got):
        lower[part], upto = upto, upto + got[part]
    inside = inside.union(ranged.mapInArrow(_across(slices, lower), _SHAPE))
    twice = (inside.agg(F.sum("twice")).first()[0] or 0) + _same_duration(g, rows)
    drop(g), drop(ranged)
    return _share(spark.createDataFrame([(twice / 2, int(pairs))], "concordant double, pairs long"))


def concordance(obs: DataFrame, duration: str = "duration", event: str = "event", risk: str = "risk") -> DataFrame:
    return by_blocks(obs, duration, event, risk)
