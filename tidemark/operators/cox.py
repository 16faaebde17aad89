"""Cox proportional hazards with Breslow ties.

A fit puts the cases in order of falling duration once, dealt by ranges and packed into blocks of numbers that
stay stored. An evaluation of the partial likelihood then builds no plan of its own: one pass sums each range's
risk weights (S0, S1, S2), and a second, with the sums of the ranges before as its start, adds up the log
likelihood, the gradient and the Hessian; a single range needs the second alone. What comes to the driver is a
row of some p * p numbers a range. Newton's steps are on the driver. `likelihood` is the same in frames, for one
evaluation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import cumulative
from ..functions.shared import cut, drop
from ..functions.stats import chi2_sf, inverse, normal_sf, solve
from ..plans.workers import reachable
from .asof import asof_join
from .survival import Z95

#: Cases of a block, and of a range of blocks.
BLOCK, RANGE = 1 << 16, 1 << 20


def _pairs(p: int):
    return [(i, j) for i in range(p) for j in range(i, p)]


def linear_predictor(names, beta, centre=None) -> Column:
    out = F.lit(0.0)
    for i, (n, b) in enumerate(zip(names, beta)):
        out = out + float(b) * (F.col(n) - float(centre[i]) if centre is not None else F.col(n))
    return out


def likelihood(obs: DataFrame, names, beta, duration: str = "duration", event: str = "event", centre=None) -> DataFrame:
    """One row: ll, g0..., h0_0... (upper triangle) of the partial likelihood at beta."""
    p = len(names)
    d = obs.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("double").alias("e"), *[(F.col(n).cast("double") - (float(centre[i]) if centre is not None else 0.0)).alias(f"x{i}") for i, n in enumerate(names)])
    d = d.withColumn("w", F.exp(linear_predictor([f"x{i}" for i in range(p)], beta)))
    aggs = [F.sum("e").alias("d"), F.sum("w").alias("w")]
    aggs += [F.sum(F.col("e") * F.col(f"x{i}")).alias(f"ex{i}") for i in range(p)] + [F.sum(F.col("w") * F.col(f"x{i}")).alias(f"wx{i}") for i in range(p)]
    aggs += [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"wxx{i}_{j}") for i, j in _pairs(p)]
    t = d.groupBy("t").agg(*aggs)
    sums = {"s0": F.col("w")} | {f"s1_{i}": F.col(f"wx{i}") for i in range(p)} | {f"s2_{i}_{j}": F.col(f"wxx{i}_{j}") for i, j in _pairs(p)}
    t = cumulative(t, "t", sums, descending=True).where("d > 0")
    lp = F.lit(0.0)
    for i, b in enumerate(beta):
        lp = lp + float(b) * F.col(f"ex{i}")
    m = lambda i: F.col(f"s1_{i}") / F.col("s0")
    return t.agg(
        F.sum(lp - F.col("d") * F.ln("s0")).alias("ll"), F.sum("d").alias("events"),
        *[F.sum(F.col(f"ex{i}") - F.col("d") * m(i)).alias(f"g{i}") for i in range(p)],
        *[(-F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - m(i) * m(j)))).alias(f"h{i}_{j}") for i, j in _pairs(p)],
    )


def _packed(width: int, rows: int):
    """Map: (t, e, x...) in falling t to blocks of at most `rows` cases, numbered by range."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0

        def block(held):
            data = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["part", "seq", "data"])

        held, n = [], 0
        for b in batches:
            x = np.stack([np.asarray(c, float) for c in b.columns], axis=1)
            while n + len(x) >= rows:
                held.append(x[: rows - n])
                yield block(held)
                x, held, n, seq = x[rows - n :], [], 0, seq + 1
            if len(x):
                held.append(x)
                n += len(x)
        if n:
            yield block(held)

    return run


def _lp(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return (x * beta).sum(axis=1)  # a matrix product would wake threads that a task shouldn't have


def _risk_sums(w: np.ndarray, x: np.ndarray, pairs) -> np.ndarray:
    """Columns w, w * x_i, w * x_i * x_j of each case."""
    wx = w[:, None] * x
    return np.concatenate([w[:, None], wx, *[(wx[:, i] * x[:, j])[:, None] for i, j in pairs]], axis=1)


def _blocks_of(batches, width: int):
    """A range's blocks in order, as (part, matrix)."""
    for b in batches:
        for part, data in zip(b.column(0).to_pylist(), b.column(2)):
            yield part, np.frombuffer(data.as_buffer(), float).reshape(-1, width)


def _row(part, values):
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.asarray(values, float).tobytes()], pa.binary())], ["part", "data"])


def _totals(beta: np.ndarray, pairs):
    """Map: of each range its first and last duration, its risk sums, and those of the cases at its first duration."""

    def run(batches):
        part = first = last = whole = head = None
        for part, m in _blocks_of(batches, 2 + len(beta)):
            sums = _risk_sums(np.exp(_lp(m[:, 2:], beta)), m[:, 2:], pairs)
            if first is None:
                first, whole, head = m[0, 0], 0.0, 0.0
            whole, head, last = whole + sums.sum(axis=0), head + sums[m[:, 0] == first].sum(axis=0), m[-1, 0]
        if part is not None:
            yield _row(part, np.concatenate([[first, last], whole, head]))

    return run


def _terms(beta: np.ndarray, pairs, before: dict, after: dict):
    """Map: of each range the log likelihood, events, gradient and upper Hessian of its events.

    before: risk sums of the ranges before; after: of the cases beyond the range at its last duration."""
    p = len(beta)

    def run(batches):
        part, out, at, waiting, since = None, np.zeros(2 + p + len(pairs)), None, 0.0, None

        def close(d, s):
            """Events d at ends of durations with risk sums s."""
            d, s = d[d > 0], s[d > 0]
            mean, second = s[:, 1 : 1 + p] / s[:, :1], s[:, 1 + p :] / s[:, :1]
            out[0] -= (d * np.log(s[:, 0])).sum()
            out[1] += d.sum()
            out[2 : 2 + p] -= (d[:, None] * mean).sum(axis=0)
            for k, (i, j) in enumerate(pairs):
                out[2 + p + k] -= (d * (second[:, k] - mean[:, i] * mean[:, j])).sum()

        for part, m in _blocks_of(batches, 2 + p):
            t, e, x = m[:, 0], m[:, 1], m[:, 2:]
            if at is None:
                at = np.array(before.get(part, 0.0)) + np.zeros(1 + p + len(pairs))
            lp = _lp(x, beta)
            out[0] += (e * lp).sum()
            out[2 : 2 + p] += (e[:, None] * x).sum(axis=0)
            new = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])
            d = np.add.reduceat(e, new)
            upto = at + np.cumsum(np.add.reduceat(_risk_sums(np.exp(lp), x, pairs), new, axis=0), axis=0)
            if since == t[0]:
                d[0] += waiting
            elif since is not None:
                close(np.array([waiting]), at[None, :])
            close(d[:-1], upto[:-1])
            waiting, since, at = d[-1], t[-1], upto[-1]
        if part is not None:
            close(np.array([waiting]), (at + after.get(part, 0.0))[None, :])
            yield _row(part, out)

    return run


class RiskBlocks:
    """Cases in stored blocks by falling duration, for any number of evaluations; `close` drops them."""

    def __init__(self, obs: DataFrame, cols, duration: str = "duration", event: str = "event", block: int = BLOCK, rows: int = RANGE):
        reachable(obs.sparkSession)
        self.p, self.pairs = len(cols), _pairs(len(cols))
        d = obs.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("double").alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
        source = cut(d)
        self.cases, events, *means = source.agg(F.count("*"), F.sum("e"), *[F.avg(f"x{i}") for i in range(self.p)]).first()
        self.events = int(events or 0)
        # centred, which keeps exp() in range; coefficients, likelihood and errors do not change
        self.centre = np.array([m or 0.0 for m in means], float)
        d = source.select("t", "e", *[(F.col(f"x{i}") - float(c)).alias(f"x{i}") for i, c in enumerate(self.centre)])
        self.ranges = max(1, -(-self.cases // rows))
        # one duration may hold any share of the cases: the hash lets it lie over several ranges
        d = d.coalesce(1) if self.ranges == 1 else d.repartitionByRange(self.ranges, F.col("t").desc(), F.xxhash64(*d.columns))
        self._blocks = cut(d.sortWithinPartitions(F.col("t").desc()).mapInArrow(_packed(2 + self.p, block), "part int, seq int, data binary"))
        drop(source)

    def close(self) -> None:
        drop(self._blocks)

    def _collect(self, f) -> dict[int, np.ndarray]:
        rows = self._blocks.mapInArrow(f, "part int, data binary").collect()
        return {r.part: np.frombuffer(r.data, float) for r in sorted(rows)}

    def at(self, beta) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood, gradient and Hessian."""
        beta, p = np.asarray(beta, float), self.p
        before, after = {}, {}
        if self.ranges > 1:
            got = self._collect(_totals(beta, self.pairs))
            parts, size, upto = list(got), 1 + p + len(self.pairs), 0.0
            for k, part in enumerate(parts):
                before[part] = upto
                upto = upto + got[part][2 : 2 + size]
                for later in parts[k + 1 :]:  # the last duration may go on in the ranges that follow
                    first, last = got[later][:2]
                    if first != got[part][1]:
                        break
                    after[part] = after.get(part, 0.0) + got[later][2 + size :]
                    if last != first:
                        break
        out = sum(self._collect(_terms(beta, self.pairs, before, after)).values(), np.zeros(2 + p + len(self.pairs)))
        h = np.zeros((p, p))
        for k, (i, j) in enumerate(self.pairs):
            h[i, j] = h[j, i] = out[2 + p + k]
        return out[0], out[2 : 2 + p], h


def baseline(obs: DataFrame, names, beta, duration: str = "duration", event: str = "event") -> DataFrame:
    """time, hazard, cumulative_hazard at event times (Breslow)."""
    d = obs.select(F.col(duration).cast("double").alias("time"), F.col(event).cast("double").alias("e"), F.exp(linear_predictor(names, beta)).alias("w"))
    t = d.groupBy("time").agg(F.sum("e").alias("d"), F.sum("w").alias("w"))
    t = cumulative(t, "time", {"s0": F.col("w")}, descending=True).where("d > 0").select("time", (F.col("d") / F.col("s0")).alias("hazard"))
    return cumulative(t, "time", {"cumulative_hazard": F.col("hazard")})


@dataclass
class CoxModel:
    names: list[str]
    beta: list[float]
    std_error: list[float]
    log_likelihood: float
    null_log_likelihood: float
    iterations: int
    converged: bool
    cases: int
    events: int
    #: The baseline hazard's frame, or what makes it when it is first asked for.
    curve: DataFrame | Callable[[], DataFrame] | None = field(repr=False, default=None)

    @property
    def base(self) -> DataFrame:
        if callable(self.curve):
            self.curve = self.curve()
        return self.curve

    @property
    def hazard_ratios(self):
        return [math.exp(b) for b in self.beta]

    @property
    def z(self):
        return [b / s if s > 0 else float("nan") for b, s in zip(self.beta, self.std_error)]

    @property
    def p_values(self):
        return [2 * normal_sf(abs(z)) if z == z else float("nan") for z in self.z]

    def intervals(self, z: float = Z95):
        return [(math.exp(b - z * s), math.exp(b + z * s)) for b, s in zip(self.beta, self.std_error)]

    @property
    def likelihood_ratio(self):
        stat = 2 * (self.log_likelihood - self.null_log_likelihood)
        return stat, chi2_sf(stat, max(1, len(self.beta)))

    def coefficient(self, name: str) -> float:
        return self.beta[self.names.index(name)]

    def rows(self) -> list[dict]:
        ci = self.intervals()
        return [{"covariate": n, "coef": b, "se": s, "hazard_ratio": h, "lower": lo, "upper": hi, "z": z, "p": p} for n, b, s, h, (lo, hi), z, p in zip(self.names, self.beta, self.std_error, self.hazard_ratios, ci, self.z, self.p_values)]

    def to_text(self) -> str:
        """The coefficients as a table, and how the model was fitted."""
        stat, p = self.likelihood_ratio
        head = f"{'covariate':<28}{'coef':>9}{'se':>9}{'hazard ratio':>14}{'95% interval':>20}{'z':>8}{'p':>9}"
        body = [f"{r['covariate']:<28}{r['coef']:>9.4f}{r['se']:>9.4f}{r['hazard_ratio']:>14.3f}{'%.3f to %.3f' % (r['lower'], r['upper']):>20}{r['z']:>8.2f}{r['p']:>9.4f}" for r in self.rows()]
        tail = f"{self.cases} cases, {self.events} events; log likelihood {self.log_likelihood:.3f} (null {self.null_log_likelihood:.3f}); likelihood ratio {stat:.2f}, p {p:.4g}; " + (f"converged in {self.iterations} steps" if self.converged else "not converged")
        return "\n".join([head, *body, tail])

    def score(self, cases: DataFrame, prefix: str = "x_") -> Column:
        return linear_predictor([prefix + n for n in self.names], self.beta)

    def hazard_at(self, time: float) -> float:
        """Baseline cumulative hazard, a right-continuous step; 0 before the first event."""
        r = self.base.where(F.col("time") <= time).agg(F.max("cumulative_hazard")).first()[0]
        return 0.0 if r is None else r

    def breach_probability(self, cases: DataFrame, sla_hours: float) -> DataFrame:
        """Adds risk (linear predictor) and breach_probability: the chance to outlast sla_hours."""
        if sla_hours <= 0:
            raise ValueError("the target must be positive")
        risk = self.score(cases)
        return cases.withColumn("risk", risk).withColumn("breach_probability", F.exp(-F.lit(self.hazard_at(sla_hours)) * F.exp("risk")))

    def breach_by_target(self, cases: DataFrame, sla: str = "sla_hours") -> DataFrame:
        """As breach_probability with each case's own target: the hazard as of each distinct target."""
        targets = cases.select(F.col(sla).cast("double").alias("_sla")).where("_sla IS NOT NULL").distinct()
        look = asof_join(targets, self.base.select("time", "cumulative_hazard"), ("_sla", "time")).select("_sla", F.coalesce("cumulative_hazard", F.lit(0.0)).alias("_h"))
        got = cases.join(look, F.col(sla).cast("double") == F.col("_sla")).withColumn("risk", self.score(cases))
        return got.withColumn("breach_probability", F.exp(-F.col("_h") * F.exp("risk"))).drop("_sla", "_h")


def contributions(model: CoxModel, values: dict[str, float]) -> list[tuple[str, float]]:
    """Each covariate's part of the linear predictor, largest first."""
    return sorted(((n, b * values.get(n, 0.0)) for n, b in zip(model.names, model.beta)), key=lambda x: -abs(x[1]))


def survival_curve(model: CoxModel, values: dict[str, float]) -> DataFrame:
    lp = sum(b * values.get(n, 0.0) for n, b in zip(model.names, model.beta))
    return model.base.select("time", F.exp(-F.col("cumulative_hazard") * math.exp(lp)).alias("survival"))


def curve_quantile(model: CoxModel, values: dict[str, float], p: float = 0.5) -> float | None:
    """First event time at which the scored curve is at most 1 - p; None if it never is."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    return survival_curve(model, values).where(F.col("survival") <= 1 - p).agg(F.min("time")).first()[0]


def fit_cox(obs: DataFrame, names, duration: str = "duration", event: str = "event", prefix: str = "x_", iterations: int = 50, tolerance: float = 1e-9) -> CoxModel:
    cols, p = [prefix + n for n in names], len(names)
    blocks = RiskBlocks(obs, cols, duration, event)
    try:
        if not blocks.events:
            raise ValueError("no events: a hazard model cannot be fitted")
        at = blocks.at
        beta, done, used = np.zeros(p), False, 0
        ll, g, h = at(beta)
        null = ll
        for used in range(1, iterations + 1):
            try:
                step = solve(-h, g)
            except ValueError:
                raise ValueError("the information matrix is singular: covariates are collinear or constant") from None
            size = 1.0
            for _ in range(30):
                new = at(beta + size * step)
                if new[0] >= ll - 1e-12:
                    break
                size /= 2
            gain, beta = new[0] - ll, beta + size * step
            ll, g, h = new
            if abs(gain) <= tolerance * (abs(ll) + tolerance):
                done = True
                break
        try:
            se = [math.sqrt(v) if v > 0 else float("nan") for v in np.diag(inverse(-h))]
        except ValueError:
            se = [float("nan")] * p
        return CoxModel(list(names), beta.tolist(), se, ll, null, used, done, blocks.cases, blocks.events, lambda: baseline(obs, cols, beta, duration, event))
    finally:
        blocks.close()
