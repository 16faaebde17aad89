"""As-of join: each row of the left takes the last row of the right at or before it, within equal keys.

Both sides, as one frame, are sorted by (keys, time) in ranges: a range holds any number of keys, and a key any
number of ranges, so no key is hot. Within a range the last right row is carried along by a window. What a range
leaves to those that follow is one row: its last right row; a key that goes on takes that of the nearest range
before it that has one of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.shared import cut


def asof_join(left: DataFrame, right: DataFrame, on: tuple[str, str], by: Sequence[str] = (), strict: bool = False, rows: int | None = None) -> DataFrame:
    """left's rows and columns, with right's other columns of its last row at or before (strict: before) each.

    on: the time columns of left and right; by: key columns of both, matched as equal (null with null). Rows of
    the right with a null time match nothing, and of equal times one row counts, the greatest by its other
    columns; rows of the left with a null time, or nothing before them, get nulls. Right columns named as one of
    the left's end in _right."""
    (at, other), by, rows = on, list(by), rows or ordered.ROWS
    theirs = [c for c in right.columns if c not in by]
    names = {c: c if c not in left.columns else c + "_right" for c in theirs}
    mine, key = F.struct(*[F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns)]), [f"_b{i}" for i in range(len(by))]
    values = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(theirs)])
    kind = right.select(values.alias("v")).schema["v"].dataType
    kept = left.schema
    # at one time the right comes first, or last where it must lie before
    turn = (0, 1) if not strict else (1, 0)
    one = right.where(F.col(other).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, key)], F.col(other).alias("_t"), F.lit(turn[0]).alias("_side"), values.alias("_right"))
    one = one.groupBy(*key, "_t", "_side").agg(F.max("_right").alias("_right"))
    two = left.select(*[F.col(c).alias(k) for c, k in zip(by, key)], F.col(at).alias("_t"), F.lit(turn[1]).alias("_side"), mine.alias("_left"))
    both = one.withColumn("_left", F.lit(None).cast(two.schema["_left"].dataType)).unionByName(two.withColumn("_right", F.lit(None).cast(kind)))
    both = both.withColumn("_hash", F.xxhash64("_left"))  # spreads rows of one key and time
    order = [*key, "_t", "_side", "_hash"]
    both = cut(both)
    n = both.count()
    w = Window.partitionBy("_part", *key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last("_right", ignorenulls=True).over(w)
    if n <= rows:
        got = both.withColumn("_part", F.lit(0)).withColumn("_right", carried)
    else:
        laid = cut(both.repartitionByRange(-(-n // rows), *order).withColumn("_part", F.spark_partition_id()))
        # the last right row of each range: one row a range
        has = laid.where("_right IS NOT NULL").groupBy("_part").agg(F.max(F.struct(*key, "_t", "_right")).alias("_last"))
        ends = laid.select("_part").distinct().join(has, "_part", "left")
        before = F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        starts = ends.select(F.col("_part").alias("_p"), before.alias("_before"))
        got = laid.withColumn("_own", carried).join(starts, F.col("_part") == F.col("_p"))
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"_before.{k}"))
        got = got.withColumn("_right", F.coalesce("_own", F.when(same, F.col("_before._right"))))
    got = got.where("_left IS NOT NULL")
    hit = F.col("_t").isNotNull()
    return got.select(*[F.col(f"_left.l{i}").alias(c) for i, c in enumerate(kept.names)], *[F.when(hit, F.col(f"_right.r{i}")).alias(names[c]) for i, c in enumerate(theirs)])
