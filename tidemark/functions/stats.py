"""Scalar statistics for the driver side of an operator (Spark SQL has no erf)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd

_N = NormalDist()


def mean(values) -> float:
    values = list(values)
    if not values:
        raise ValueError("mean of no values")
    return math.fsum(values) / len(values)


def stdev(values, ddof: int = 1) -> float:
    values = list(values)
    if len(values) <= ddof:
        raise ValueError("too few values for a standard deviation")
    m = mean(values)
    return math.sqrt(math.fsum((v - m) ** 2 for v in values) / (len(values) - ddof))


def quantile(values, q: float) -> float:
    """Linear interpolation between order statistics (type 7)."""
    v = sorted(values)
    if not v or not 0 <= q <= 1:
        raise ValueError("quantile needs values and 0 <= q <= 1")
    return float(np.quantile(np.array(v, float), q))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("probability must lie strictly between 0 and 1")
    return _N.inv_cdf(p)


def _over_batches(f):
    """A scalar function as a column function, by Arrow batches."""
    from pyspark.sql import functions as F

    def apply(column):
        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return x.map(lambda v: None if pd.isna(v) else f(float(v))).astype("float64")

        return run(column)

    return apply


#: Column forms: normal_cdf_column("x"), and so on; null where the value is null.
normal_cdf_column, normal_sf_column, normal_ppf_column = (_over_batches(f) for f in (normal_cdf, normal_sf, normal_ppf))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution: the regularised upper incomplete gamma at (df/2, x/2)."""
    if df < 1:
        raise ValueError("degrees of freedom must be at least 1")
    if x <= 0:
        return 1.0
    z, a = x / 2, df / 2
    # integer steps from Q(1/2) or Q(1), each adding z**a e**-z / gamma(a + 1)
    q, at = (math.erfc(math.sqrt(z)), 0.5) if df % 2 else (math.exp(-z), 1.0)
    while at < a:
        q += math.exp(at * math.log(z) - z - math.lgamma(at + 1))
        at += 1
    return min(1.0, max(0.0, q))


def _upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x), elementwise: the power series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(x.shape)
    kinds, which = np.unique(a, return_inverse=True)
    log_gamma = np.array([math.lgamma(k) for k in kinds])[which].reshape(a.shape)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - log_gamma)
        low = (x > 0) & (x < a + 1)
        if low.any():
            b, y = a[low], x[low]
            term = total = 1 / b
            for n in range(1, 10_000):
                term = term * y / (b + n)
                total = total + term
                if (term <= total * 1e-17).all():
                    break
            out[low] = 1 - front[low] * total
        high = (x >= a + 1) & np.isfinite(x)
        if high.any():
            b, y = a[high], x[high]
            p, q = y + 1 - b, np.full(y.shape, 1e300)
            d = 1 / p
            h = d
            for n in range(1, 10_000):
                k = n * (b - n)
                p = p + 2
                d = 1 / (p + k * d)
                q = p + k / q
                h = h * d * q
                if (np.abs(d * q - 1) < 1e-16).all():
                    break
            out[high] = front[high] * h
        out[x == np.inf] = 0.0
    return np.clip(out, 0.0, 1.0)


def chi2_sf_column(x, df):
    """Column form of chi2_sf, by Arrow batches; df a column or a number. Null where either is null or df is below 1."""
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        ok = x.notna() & (df >= 1)
        out = pd.Series(np.nan, index=x.index)
        out[ok] = _upper_gamma(df[ok].to_numpy(float) / 2, x[ok].to_numpy(float) / 2)
        return out.where(ok, None).astype("Float64") if not ok.all() else out

    return run(x, df if not isinstance(df, (int, float)) else F.lit(float(df)))


def solve(matrix, right) -> np.ndarray:
    """Solution of a linear system; ValueError when it is singular to working precision."""
    a = np.array(matrix, float)
    scale = np.sqrt(np.abs(np.diag(a)))
    if not np.isfinite(a).all() or (scale <= 0).any() or np.linalg.cond(a / np.outer(scale, scale)) > 1e12:
        raise ValueError("the matrix is singular")
    return np.linalg.solve(a, np.array(right, float))


def inverse(matrix) -> np.ndarray:
    return solve(matrix, np.eye(len(matrix)))
