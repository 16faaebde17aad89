"""Ordered windows and running sums over any number of rows, without one task that holds them all.

`lay_out` puts rows in order once: up to `ROWS` rows are one block; more are dealt by ranges of the order
column (of any sortable type, cut where Spark's sample of it says), one block a range, so blocks grow in number
and not in size. All windows, numbers and running sums of an operator then share that layout. What a block
needs from those before it is little: the sums of their totals, or their last rows (the halo).

A layout is stored in the shared folder, so that plans on it start there and lost executors cost nothing; it
stays until `release`, as frames made from it read it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop

ROWS = 100_000
_stored: list[DataFrame] = []


def _store(df: DataFrame) -> DataFrame:
    _stored.append(cut(df))
    return _stored[-1]


def release() -> None:
    """Delete the stored layouts of this session: frames made from them can't be read any more."""
    while _stored:
        drop(_stored.pop())


@dataclass
class Layout:
    """frame: rows with _blk, which rises with `order`; rows equal in it share a block."""

    frame: DataFrame
    order: str
    blocks: int

    def window(self, descending: bool = False) -> Window:
        c = F.col(self.order)
        return Window.partitionBy("_blk").orderBy(c.desc() if descending else c.asc())

    def having(self, frame: DataFrame) -> Layout:
        return Layout(frame, self.order, self.blocks)

    def plain(self) -> DataFrame:
        return self.frame.drop("_blk")

    def running(self, columns: dict[str, Column], descending: bool = False, products: dict[str, Column] | None = None) -> Layout:
        """Adds running sums (and products) over rows in order (which tells them apart), inclusive."""
        exprs = [(k, c, F.sum) for k, c in columns.items()] + [(k, c, F.product) for k, c in (products or {}).items()]
        w = self.window(descending).rowsBetween(Window.unboundedPreceding, 0)
        d = self.frame.withColumns({f"_c{i}": c for i, (_, c, _) in enumerate(exprs)})
        names = [f"_c{i}" for i in range(len(exprs))]
        if self.blocks == 1:
            return self.having(d.withColumns({k: f(f"_c{i}").over(w) for i, (k, _, f) in enumerate(exprs)}).drop(*names))
        side = Window.orderBy(F.col("_blk").desc() if descending else F.col("_blk").asc()).rowsBetween(Window.unboundedPreceding, -1)
        sums = d.groupBy("_blk").agg(*[f(f"_c{i}").alias(f"_s{i}") for i, (_, _, f) in enumerate(exprs)])
        # one row a block
        sums = sums.select(F.col("_blk").alias("_kb"), *[F.coalesce(f(f"_s{i}").over(side), F.lit(1 if f is F.product else 0)).alias(f"_t{i}") for i, (_, _, f) in enumerate(exprs)])
        d = d.join(sums, F.col("_blk") == F.col("_kb"))
        d = d.withColumns({k: (F.product(f"_c{i}").over(w) * F.col(f"_t{i}") if f is F.product else F.sum(f"_c{i}").over(w) + F.col(f"_t{i}")) for i, (k, _, f) in enumerate(exprs)})
        return self.having(d.drop("_kb", *names, *[f"_t{i}" for i in range(len(exprs))]))

    def over(self, halo: int, add: Callable[[DataFrame, Window], DataFrame]) -> Layout:
        """add(frame, window) over each block with the `halo` rows before it; `order` tells rows apart."""
        if not halo or self.blocks == 1:
            return self.having(add(self.frame, self.window()))
        d, order = self.frame.withColumn("_own", F.lit(True)), self.order
        tails = d.withColumn("_at", F.row_number().over(self.window(descending=True))).where(F.col("_at") <= halo)
        # last rows of all blocks, numbered: a block takes the `halo` numbers below its first; one row a block
        upto = tails.groupBy(F.col("_blk").alias("_kb")).agg(F.count("*").alias("_kn")).withColumn("_kend", F.sum("_kn").over(Window.orderBy("_kb").rowsBetween(Window.unboundedPreceding, 0)))
        first = F.col("_kend") - F.col("_kn")
        wanted = upto.where(first > 0).select(F.col("_kb").alias("_to"), F.explode(F.sequence(F.greatest(first - halo, F.lit(0)), first - 1)).alias("_i"))
        near = tails.join(upto, F.col("_blk") == F.col("_kb")).withColumn("_i", F.col("_kend") - F.col("_at")).join(wanted, "_i")
        near = near.withColumns({"_blk": F.col("_to"), "_own": F.lit(False)}).select(*d.columns)
        return self.having(add(d.unionByName(near), self.window()).where("_own").drop("_own"))

    def numbered(self, out: str) -> Layout:
        """Adds out: 1, 2, 3... in order."""
        got = self.running({out: F.lit(1)})
        return self.having(got.frame.withColumn(out, F.col(out).cast("int")))


def lay_out(df: DataFrame, order: str, rows: int | None = None, keep: bool = True) -> Layout:
    """Rows in order. keep: store them, where they cost more than a scan to compute."""
    rows = rows or ROWS
    source = cut(df) if keep else df
    n = source.count()
    if n <= rows:
        if keep:
            _stored.append(source)
        return Layout(source.withColumn("_blk", F.lit(0)), order, 1)
    blocks = -(-n // rows)
    laid = _store(source.repartitionByRange(blocks, F.col(order)).withColumn("_blk", F.spark_partition_id()))
    if keep:
        drop(source)
    return Layout(laid, order, blocks)


def cumulative(df: DataFrame, by: str, columns: dict[str, Column], descending: bool = False, products: dict[str, Column] | None = None) -> DataFrame:
    """Running sums (and products) over rows ordered by `by` (unique), inclusive. columns: output name to expression."""
    return lay_out(df, by).running(columns, descending, products).plain()
