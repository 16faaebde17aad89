"""Nelson's run rules as counts over row frames of a standardised series.

A flag lands on the point that completes the pattern; a rule stays silent until its window is full.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import Layout, lay_out


@dataclass(frozen=True)
class RunRule:
    number: int
    window: int
    description: str
    flag: Callable[[Column, Window], Column]

    @property
    def code(self) -> str:
        return f"NELSON_{self.number}"


def _count(test: Column, k: int, w) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).over(w.rowsBetween(1 - k, 0))


def _beyond(z: Column, level: float, hits: int, k: int, w) -> Column:
    """The point is beyond the level, as are `hits` of the last k, all beyond on one side."""
    up, down = _count(z > level, k, w), _count(z < -level, k, w)
    return (F.abs(z) > level) & (((up >= hits) & (down == 0)) | ((down >= hits) & (up == 0)))


def _one_side(z, w):
    return (_count(z > 0, 9, w) == 9) | (_count(z < 0, 9, w) == 9)


def _both_sides(z, w):
    return (_count(F.abs(z) > 1, 8, w) == 8) & (_count(z > 0, 8, w) > 0) & (_count(z < 0, 8, w) > 0)


RULES = (
    RunRule(1, 1, "a point beyond three sigma", lambda z, w: F.abs(z) > 3),
    RunRule(2, 9, "nine points on one side of the centre", _one_side),
    RunRule(3, 6, "six points steadily rising or falling", None),
    RunRule(4, 14, "fourteen points alternating up and down", None),
    RunRule(5, 3, "two of three points beyond two sigma on one side", lambda z, w: _beyond(z, 2, 2, 3, w)),
    RunRule(6, 5, "four of five points beyond one sigma on one side", lambda z, w: _beyond(z, 1, 4, 5, w)),
    RunRule(7, 15, "fifteen points within one sigma", lambda z, w: _count(F.abs(z) < 1, 15, w) == 15),
    RunRule(8, 8, "eight points beyond one sigma on both sides", _both_sides),
)


def flags(df: DataFrame | Layout, z: str, order: str, rules: Sequence[int | RunRule] | None = None) -> DataFrame:
    """Adds violations, the codes of the rules that the point completes, in the rules' order.

    rules: numbers of the built-in rules, or RunRules of one's own (flag takes the column and the window).
    df: the series, or a layout of it."""
    chosen = [r if isinstance(r, RunRule) else RULES[r - 1] for r in (rules if rules is not None else range(1, 9))]

    def add(d, w):
        d = d.withColumn("_step", F.col(z) - F.lag(z).over(w))
        d = d.withColumn("_turn", F.col("_step") * F.lag("_step").over(w) < 0)
        made = []
        for r in chosen:
            if r.number == 3 and r.flag is None:
                test = (_count(F.col("_step") > 0, 5, w) == 5) | (_count(F.col("_step") < 0, 5, w) == 5)
            elif r.number == 4 and r.flag is None:
                test = _count(F.col("_turn"), 12, w) == 12
            else:
                test = r.flag(F.col(z), w)
            made.append(F.when(test & (F.row_number().over(w) >= r.window), F.lit(r.code)))
        none = F.expr("cast(array() as array<string>)")
        return d.withColumn("violations", F.array_compact(F.array(*made)) if made else none).drop("_step", "_turn")

    # a block starts with as many rows of those before as the longest rule looks back
    at = df if isinstance(df, Layout) else lay_out(df, order)
    return at.over(max([r.window for r in chosen], default=1) - 1, add).plain()


def expand(df: DataFrame, order: str, rules: Sequence[RunRule] = RULES) -> DataFrame:
    """Widen each flag back over the window that it completes; codes of no rule are left out."""
    back = {r.code: r.window for r in rules}

    def add(d, w):
        flag = lambda c: F.when(F.array_contains("violations", c), 1).otherwise(0)
        wide = [F.when(F.max(flag(c)).over(w.rowsBetween(1 - n, 0)) == 1, F.lit(c)) for c, n in back.items()]
        return d.withColumn("violations", F.array_compact(F.array(*wide)))

    # looking ahead is looking back in falling order
    turned = lay_out(df.withColumn("_turned", -F.col(order)), "_turned").over(max(back.values(), default=1) - 1, add)
    return turned.plain().drop("_turned")
