"""Design matrix: attributes to DOUBLE columns x_..., in the order numeric, binary, categorical."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Design:
    frame: DataFrame
    names: list[str]
    references: dict[str, str]


def _name(attribute: str, level: str) -> str:
    return f"{attribute}_{level}".lower().replace(" ", "_")


def design_matrix(cases: DataFrame, numeric: Sequence[str] = (), binary: Mapping[str, str] | None = None, categorical: Sequence[str] = (), reference: Mapping[str, str] | None = None) -> Design:
    """numeric: cast, a bad number raises; binary: 1 where the attribute has the level; categorical: one
    column a level but the reference (first alphabetically by default; a missing attribute is level '')."""
    binary, reference = dict(binary or {}), dict(reference or {})
    columns: dict[str, object] = {}
    for a in numeric:
        x = F.expr(f"try_cast(`{a}` AS DOUBLE)")
        columns[a] = F.when(x.isNull(), F.raise_error(F.format_string(f"attribute {a} is not a number: %s", F.coalesce(F.col(a).cast("string"), F.lit("")))).cast("double")).otherwise(x)
    for a, level in binary.items():
        columns[_name(a, level)] = F.when(F.coalesce(F.col(a).cast("string"), F.lit("")) == level, 1.0).otherwise(0.0)
    found = cases.agg(*[F.collect_set(F.coalesce(F.col(a).cast("string"), F.lit(""))).alias(f"l{i}") for i, a in enumerate(categorical)]).first() if categorical else []
    references = {}
    for a, levels in zip(categorical, found):
        base = reference.get(a, min(levels) if levels else "")
        if levels and base not in levels:
            raise ValueError(f"reference level {base!r} of {a} does not occur")
        references[a] = base
        for level in sorted(set(levels) - {base}):
            columns[_name(a, level)] = F.when(F.coalesce(F.col(a).cast("string"), F.lit("")) == level, 1.0).otherwise(0.0)
    return Design(cases.withColumns({f"x_{k}": v for k, v in columns.items()}), list(columns), references)
