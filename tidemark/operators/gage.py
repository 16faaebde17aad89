"""Crossed gage repeatability and reproducibility (two-way ANOVA) from grouping sets."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sums_of_squares(df: DataFrame, part: str, operator: str, value: str) -> DataFrame:
    """One row: parts, operators, replicates, and the sums of squares.

    One pass of grouping sets gives the counts, sums and squares of cells, parts, operators and all; the
    rest is arithmetic on those few rows. Values are centred first, for accuracy."""
    mid = df.agg(F.avg(value).alias("_mid"))
    d = df.select(F.col(part).alias("_p"), F.col(operator).alias("_o"), F.col(value).cast("double").alias("_v")).crossJoin(F.broadcast(mid)).withColumn("_v", F.col("_v") - F.col("_mid"))
    g = d.groupingSets([["_p", "_o"], ["_p"], ["_o"], []], "_p", "_o").agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"))
    mean_square = F.col("s") * F.col("s") / F.col("n")
    pick = lambda k, x: F.sum(F.when(F.col("_g") == k, x))
    r = g.agg(
        F.sum(F.when(F.col("_g") == 1, 1).otherwise(0)).alias("parts"), F.sum(F.when(F.col("_g") == 2, 1).otherwise(0)).alias("operators"), F.sum(F.when(F.col("_g") == 0, 1).otherwise(0)).alias("cells"),
        F.min(F.when(F.col("_g") == 0, F.col("n"))).alias("replicates"), F.max(F.when(F.col("_g") == 0, F.col("n"))).alias("most"),
        pick(0, mean_square).alias("c"), pick(1, mean_square).alias("p"), pick(2, mean_square).alias("o"), pick(3, mean_square).alias("t"), pick(3, F.col("q")).alias("q"),
    )
    return r.select(
        "parts", "operators", "cells", "replicates", "most",
        (F.col("p") - F.col("t")).alias("ss_part"), (F.col("o") - F.col("t")).alias("ss_operator"),
        (F.col("c") - F.col("p") - F.col("o") + F.col("t")).alias("ss_interaction"), (F.col("q") - F.col("c")).alias("ss_error"), (F.col("q") - F.col("t")).alias("ss_total"),
    )


@dataclass
class GageReport:
    parts: int
    operators: int
    replicates: int
    var_repeatability: float
    var_operator: float
    var_interaction: float
    var_part: float
    notes: list[str] = field(default_factory=list)

    @property
    def var_gage(self) -> float:
        return self.var_repeatability + self.var_operator + self.var_interaction

    @property
    def var_total(self) -> float:
        return self.var_gage + self.var_part

    def _parts(self) -> dict:
        return {"repeatability": self.var_repeatability, "reproducibility": self.var_operator, "interaction": self.var_interaction, "gage_rr": self.var_gage, "part_to_part": self.var_part}

    @property
    def contribution(self) -> dict:
        return {k: 100 * v / self.var_total for k, v in self._parts().items()} if self.var_total > 0 else {}

    @property
    def study_variation(self) -> dict:
        return {k: 100 * math.sqrt(v / self.var_total) for k, v in self._parts().items()} if self.var_total > 0 else {}

    @property
    def distinct_categories(self) -> int:
        return int(1.41 * math.sqrt(self.var_part / self.var_gage)) if self.var_gage > 0 else 0

    @property
    def verdict(self) -> str:
        share = self.study_variation.get("gage_rr")
        if share is None:
            return "unacceptable"
        return "acceptable" if share < 10 else "marginal" if share < 30 else "unacceptable"


def gage_rr(df: DataFrame, part: str, operator: str, value: str) -> GageReport:
    r = sums_of_squares(df, part, operator, value).first()
    if not r.parts or r.parts < 2 or r.operators < 2:
        raise ValueError("a gage study needs at least two parts and two operators")
    if r.cells != r.parts * r.operators or r.replicates != r.most or r.replicates < 2:
        raise ValueError("a gage study must be balanced, with at least two replicates a cell")
    p, o, n = r.parts, r.operators, r.replicates
    ms = {"part": r.ss_part / (p - 1), "operator": r.ss_operator / (o - 1), "both": r.ss_interaction / ((p - 1) * (o - 1)), "error": r.ss_error / (p * o * (n - 1))}
    raw = {"interaction": (ms["both"] - ms["error"]) / n, "operator": (ms["operator"] - ms["both"]) / (p * n), "part": (ms["part"] - ms["both"]) / (o * n)}
    notes = [f"the {k} component came out negative and counts as zero" for k, v in raw.items() if v < 0]
    low = {k: max(0.0, v) for k, v in raw.items()}
    report = GageReport(p, o, n, ms["error"], low["operator"], low["interaction"], low["part"], notes)
    if report.distinct_categories < 5:
        notes.append("fewer than five distinct categories: the gage cannot rank the parts reliably")
    return report
