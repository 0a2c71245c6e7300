"""Log-gamma as a Column; beta, Student-t and chi-square tails as Arrow UDFs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
SHIFT = 8


def with_lgamma(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add log-gamma columns: Stirling series after shifting the argument by eight.

    The argument and x (x + 7) are columns of their own, so each is computed once and the
    generated code stays small: x (x+1) ... (x+7) = t (t+6) (t+10) (t+12) with t = x (x+7).
    """
    x = df.withColumns({f"_x_{n}": c for n, c in columns.items()})
    t = x.selectExpr("*", *[f"_x_{n} * (_x_{n} + 7D) AS _t_{n}" for n in columns], *[f"1D / (_x_{n} + 8D) AS _i_{n}" for n in columns])
    t = t.selectExpr("*", *[f"_i_{n} * _i_{n} AS _q_{n}" for n in columns])
    # Coefficients of the Stirling series.
    value = (
        "(_x_{0} + 7.5D) * ln(_x_{0} + 8D) - (_x_{0} + 8D) + {1!r}D"
        " + _i_{0} * (1D / 12D - _q_{0} * (1D / 360D - _q_{0} * (1D / 1260D - _q_{0} / 1680D)))"
        " - ln(_t_{0} * (_t_{0} + 6D) * (_t_{0} + 10D) * (_t_{0} + 12D)) AS {0}"
    )
    return t.selectExpr(*df.columns, *[value.format(n, HALF_LOG_2PI) for n in columns])


def _np_lgamma(x: np.ndarray) -> np.ndarray:
    z = x + SHIFT
    product = np.ones_like(x)
    for i in range(SHIFT):
        product = product * (x + i)
    inv = 1.0 / z
    inv2 = inv * inv
    series = inv * (1 / 12.0 - inv2 * (1 / 360.0 - inv2 * (1 / 1260.0 - inv2 / 1680.0)))
    return (z - 0.5) * np.log(z) - z + HALF_LOG_2PI + series - np.log(product)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    return h


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, element by element."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    swap = inside > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - inside, inside)
    front = aa * np.log(xx) + bb * np.log1p(-xx) + _np_lgamma(a + b) - _np_lgamma(a) - _np_lgamma(b)
    value = np.exp(front) * _fraction(aa, bb, xx) / aa
    value = np.where(swap, 1.0 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def beta_inverse(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile by bisection on the distribution function."""
    p, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (p, a, b)))
    lo, hi = np.zeros_like(p), np.ones_like(p)
    for _ in range(50):
        mid = 0.5 * (lo + hi)
        below = beta_cdf(mid, a, b) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return 0.5 * (lo + hi)


@F.pandas_udf(T.DoubleType())
def _beta_quantile(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for p, a, b in batches:
        ok = ((a > 0) & (b > 0)).to_numpy()
        out = np.full(len(p), np.nan)
        if ok.any():
            out[ok] = beta_inverse(p.to_numpy()[ok], a.to_numpy()[ok], b.to_numpy()[ok])
        yield pd.Series(out).where(ok, None).astype("float64")


def beta_quantile(p: float, a: Column, b: Column) -> Column:
    return F.nullif(_beta_quantile(F.lit(p), a.cast("double"), b.cast("double")), F.lit(float("nan")))


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Smallest k with P(X <= k) >= u for X binomial with n trials, by bisection on the Beta distribution."""
    low, high = np.full(len(u), -1, np.int64), np.asarray(n, np.int64).copy()
    while (high - low > 1).any():
        middle = (low + high) // 2
        inside = np.clip(middle, 0, high - 1)
        below = beta_cdf(1.0 - p, (n - inside).astype(float), (inside + 1).astype(float))
        open_ = high - low > 1
        reached = open_ & (below >= u)
        high = np.where(reached, middle, high)
        low = np.where(open_ & ~reached, middle, low)
    return high


@F.pandas_udf(T.DoubleType())
def _t_two_sided(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for rho, n in batches:
        r, size = rho.to_numpy(dtype=float), n.to_numpy(dtype=float)
        dof = np.maximum(size - 2, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t2 = r * r * dof / (1.0 - r * r)
            out = np.where(np.abs(r) >= 1.0, 0.0, beta_cdf(dof / (dof + t2), dof / 2.0, np.full_like(r, 0.5)))
        yield pd.Series(np.where(np.isnan(r) | (size < 3), np.nan, out))


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation by the t approximation."""
    return F.nullif(_t_two_sided(rho.cast("double"), n.cast("double")), F.lit(float("nan")))


@F.pandas_udf(T.DoubleType())
def _chi2_tail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2.0)))


def chi2_tail(x: Column) -> Column:
    """Upper tail of a chi-square variable with one degree of freedom."""
    return _chi2_tail(x.cast("double"))
