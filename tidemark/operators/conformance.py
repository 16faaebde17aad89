"""Declarative process rules; each yields case_id, rule, detail, and a position for order.

A rule is a column over the ordered log: null, or (detail, at) on the row where the violation shows. All
rules of a set are columns of one frame, so the log is shuffled and sorted by case once, whatever their
number; their windows share that order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .eventlog import EVENT_CORE, in_case


def _before() -> Window:
    return in_case().rowsBetween(Window.unboundedPreceding, -1)


def _whole() -> Window:
    return in_case().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _place() -> Column:
    return F.row_number().over(in_case())


def _is(activity: str) -> Column:
    return F.col("activity") == activity


def _hit(test: Column, detail: Column, at: Column | int = 0) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(test, F.struct(detail.alias("detail"), at.cast("int").alias("at")))


# The rules' codes and the texts of their details below, and the default control set.


class Rule:
    """A rule whose mark() is a column over the log in order."""

    code: str

    def mark(self) -> Column:
        raise NotImplementedError

    def violations(self, events: DataFrame) -> DataFrame:
        return violations(events, [self]).drop("ordinal")


@dataclass(frozen=True)
class RequiredActivities(Rule):
    activities: tuple[str, ...]
    code: str = "REQUIRED"

    @property
    def description(self):
        return "required in every case: " + ", ".join(self.activities)

    def mark(self) -> Column:
        missing = F.concat_ws(", ", *[F.when(F.max(F.when(_is(a), 1).otherwise(0)).over(_whole()) == 0, F.lit(a)) for a in self.activities])
        return _hit((_place() == 1) & (missing != ""), F.concat(F.lit("missing "), missing))


@dataclass(frozen=True)
class ForbiddenTransition(Rule):
    source: str
    target: str
    code: str = "FORBIDDEN"

    @property
    def description(self):
        return f"'{self.source}' is never directly followed by '{self.target}'"

    def mark(self) -> Column:
        return _hit(_is(self.source) & (F.lead("activity").over(in_case()) == self.target), F.format_string(f"'{_esc(self.source)}' -> '{_esc(self.target)}' at position %d", _place()), _place())


@dataclass(frozen=True)
class Ordering(Rule):
    before: str
    after: str
    code: str = "ORDERING"

    @property
    def description(self):
        return f"'{self.after}' only once '{self.before}' has occurred"

    def mark(self) -> Column:
        # the first `after` of a case, if nothing of either kind came before it
        earlier = F.coalesce(F.max(F.when(F.col("activity").isin(self.before, self.after), 1).otherwise(0)).over(_before()), F.lit(0))
        return _hit(_is(self.after) & (F.lit(self.after) != self.before) & (earlier == 0), F.format_string(f"'{_esc(self.after)}' occurred at position %d without a preceding '{_esc(self.before)}'", _place() - 1), _place() - 1)


@dataclass(frozen=True)
class MaxOccurrences(Rule):
    activity: str
    limit: int
    code: str = "MAX_OCCURRENCES"

    @property
    def description(self):
        return f"'{self.activity}' at most {self.limit} time(s) a case"

    def mark(self) -> Column:
        n = F.sum(F.when(_is(self.activity), 1).otherwise(0)).over(_whole())
        return _hit((_place() == 1) & (n > self.limit), F.format_string(f"'{_esc(self.activity)}' occurred %d times", n))


@dataclass(frozen=True)
class StartActivities(Rule):
    allowed: tuple[str, ...]
    code: str = "START"

    @property
    def description(self):
        return "cases start with one of: " + ", ".join(self.allowed)

    def mark(self) -> Column:
        return _hit((_place() == 1) & ~F.col("activity").isin(*self.allowed), F.format_string("started with '%s'", "activity"))


@dataclass(frozen=True)
class EndActivities(Rule):
    allowed: tuple[str, ...]
    code: str = "END"

    @property
    def description(self):
        return "cases end with one of: " + ", ".join(self.allowed)

    def mark(self) -> Column:
        return _hit((_place() == F.count(F.lit(1)).over(_whole())) & ~F.col("activity").isin(*self.allowed), F.format_string("ended with '%s'", "activity"))


@dataclass(frozen=True)
class FourEyes(Rule):
    """A checker must differ from whoever did the most recent maker activity before."""

    makers: tuple[str, ...]
    checker: str
    code: str = "FOUR_EYES"

    @property
    def description(self):
        return f"'{self.checker}' by someone other than whoever performed " + " or ".join(f"'{m}'" for m in self.makers)

    def mark(self) -> Column:
        made = F.last(F.when(F.col("activity").isin(*self.makers), F.struct("activity", "resource")), ignorenulls=True).over(_before())
        test = _is(self.checker) & ~F.col("activity").isin(*self.makers) & (F.col("resource") != "") & (F.col("resource") == made["resource"])
        return _hit(test, F.format_string("%s both performed '%s' and checked it", F.col("resource"), made["activity"]), _place())


def _whole_cases(frames, check):
    """Frames in order of case, cut at borders of cases, through check."""
    import pandas as pd

    held = []
    for f in frames:
        if not len(f):
            continue
        # the last case of a frame may go on in the next
        start = int((f["case_id"].to_numpy() != f["case_id"].iloc[-1]).sum())
        if held and held[-1]["case_id"].iloc[-1] != f["case_id"].iloc[0]:
            yield from check(pd.concat(held, ignore_index=True))
            held = []
        if start:
            yield from check(pd.concat([*held, f.iloc[:start]], ignore_index=True))
            held = []
        held.append(f.iloc[start:])
    if held:
        yield from check(pd.concat(held, ignore_index=True))


@dataclass(frozen=True)
class CustomRule:
    """Any check in Python: the slow path, in batches of many whole cases.

    check takes one case's events (a pandas frame in order) and gives its details; with whole=True it takes a
    frame of many whole cases, one after another, and gives a frame of case_id and detail, with one call for
    some ten thousand events. A case must fit in a task's memory."""

    check: Callable
    code: str = "CUSTOM"
    description: str = "a custom check"
    whole: bool = False

    def violations(self, events: DataFrame) -> DataFrame:
        import pandas as pd

        check, code, whole = self.check, self.code, self.whole

        def shaped(case, detail):
            found = pd.DataFrame({"case_id": list(case), "rule": code, "detail": [str(x) for x in detail]}, dtype=object)
            found["at"] = found.groupby("case_id", sort=False).cumcount().astype("int32") if len(found) else pd.Series([], dtype="int32")
            return found

        def run(pdf):
            if whole:
                got = check(pdf)
                yield shaped(got["case_id"], got["detail"])
                return
            ids = pdf["case_id"].to_numpy()
            borders = [0, *((ids[1:] != ids[:-1]).nonzero()[0] + 1).tolist(), len(ids)]
            out = [(ids[a], x) for a, b in zip(borders, borders[1:]) for x in check(pdf.iloc[a:b])]
            yield shaped([c for c, _ in out], [x for _, x in out])

        d = events.repartition("case_id").sortWithinPartitions("case_id", "ts", "seq")
        return d.mapInPandas(lambda frames: _whole_cases(frames, run), "case_id string, rule string, detail string, at int")


def _esc(s: str) -> str:
    return s.replace("%", "%%")


DEFAULT_RULES = (
    StartActivities(("Receive Request",)),
    RequiredActivities(("Receive Request",)),
    FourEyes(("Calculate Benefit", "Apply Adjustment", "Draft Response"), "Peer Check"),
    Ordering("Peer Check", "Release Payment"),
    MaxOccurrences("Rework Calculation", 1),
)


def violations(events: DataFrame, rules: Sequence) -> DataFrame:
    """All rules' violations: case_id, rule, detail, ordinal (of the rule), at."""
    shape = "case_id, rule, detail, at, ordinal"
    out = None
    columns = {f"_m{i}": r.mark() for i, r in enumerate(rules) if isinstance(r, Rule)}
    if columns:
        marked = events.select(*EVENT_CORE).withColumns(columns)
        found = [F.when(F.col(f"_m{i}").isNotNull(), F.struct(F.lit(r.code).alias("rule"), F.col(f"_m{i}.detail").alias("detail"), F.col(f"_m{i}.at").alias("at"), F.lit(i).alias("ordinal"))) for i, r in enumerate(rules) if isinstance(r, Rule)]
        out = marked.select("case_id", F.explode(F.array_compact(F.array(*found))).alias("v")).select("case_id", "v.*").selectExpr(*shape.split(", "))
    for i, r in enumerate(rules):
        if not isinstance(r, Rule):
            v = r.violations(events).withColumn("ordinal", F.lit(i)).selectExpr(*shape.split(", "))
            out = v if out is None else out.unionByName(v)
    if out is None:
        out = events.select("case_id", F.lit("").alias("rule"), F.lit("").alias("detail"), F.lit(0).alias("at"), F.lit(0).alias("ordinal")).where("false")
    return out


def fitness(events: DataFrame, found: DataFrame) -> DataFrame:
    """cases, violating_cases, fitness (1 when there are no cases)."""
    ids = events.select("case_id", F.lit(0).alias("bad")).union(found.select("case_id", F.lit(1)))
    per = ids.groupBy("case_id").agg(F.max("bad").alias("bad"))
    got = per.agg(F.count("case_id").alias("cases"), F.coalesce(F.sum("bad"), F.lit(0)).alias("violating_cases"))
    return got.withColumn("fitness", F.when(F.col("cases") > 0, 1 - F.col("violating_cases") / F.col("cases")).otherwise(1.0))


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("violations"), F.count_distinct("case_id").alias("cases")).orderBy(F.col("violations").desc(), "rule")


def cases_for(found: DataFrame, rule: str) -> DataFrame:
    return found.where(F.col("rule") == rule).select("case_id").distinct().orderBy("case_id")


def examples(found: DataFrame, k: int = 3) -> DataFrame:
    """The first k violations of each rule: a bounded aggregate a rule, combined on the map side."""
    first = found.groupBy("rule", "ordinal", "case_id").agg(F.min(F.struct("at", "detail")).alias("v"))
    w = Window.partitionBy("rule").orderBy("case_id", "at")
    return first.select("case_id", "rule", "v.detail", "v.at", "ordinal").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def to_text(summary: dict, rules: Sequence[dict], shown: Sequence[dict] = ()) -> str:
    """The report of a collected fitness row, rows by rule, and examples."""
    out = [f"fitness {100 * summary['fitness']:.2f}%: {summary['violating_cases']} of {summary['cases']} cases break a rule"]
    for r in rules:
        out.append(f"{r['rule']:<18}{r['violations']:>7} violations in {r['cases']} cases")
        out += [f"    {x['case_id']}: {x['detail']}" for x in shown if x["rule"] == r["rule"]]
    return "\n".join(out)
