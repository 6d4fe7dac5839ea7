"""Student t and Kolmogorov distributions as column functions.

They are meant for group-level results: a handful of rows after the aggregate.
The t functions are Arrow UDFs over numpy; the Kolmogorov tail is a plain
expression.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_STEPS = 300
_TINY = 1e-300


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (DLMF 8.17.22), by
    the modified Lentz method on whole arrays."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    value = d.copy()
    for m in range(1, _STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            value = value * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return value


def beta_regularized(a, b, x) -> np.ndarray:
    """Regularized incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    inside = np.clip(x, _TINY, 1.0 - 1e-16)
    log_front = lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inside) + b * np.log1p(-inside)
    front = np.exp(log_front)
    direct = x < (a + 1.0) / (a + b + 2.0)
    low = front * _fraction(a, b, np.where(direct, x, 0.5)) / a
    high = 1.0 - front * _fraction(b, a, np.where(direct, 0.5, 1.0 - x)) / b
    result = np.where(direct, low, high)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, result))


def t_two_sided_values(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    known = np.isfinite(t) & np.isfinite(df) & (df > 0)
    safe_t, safe_df = np.where(known, t, 0.0), np.where(known, df, 1.0)
    p = beta_regularized(safe_df / 2.0, 0.5, safe_df / (safe_df + safe_t**2))
    return np.where(known, p, np.nan)


def t_cdf_values(t, df) -> np.ndarray:
    half = t_two_sided_values(t, df) / 2.0
    return np.where(np.asarray(t, dtype=float) > 0, 1.0 - half, half)


def t_ppf_values(p, df) -> np.ndarray:
    """Inverse of the t distribution by bisection on the two-sided tail."""
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    known = (p > 0) & (p < 1) & np.isfinite(df) & (df > 0)
    tail = np.where(known, 2.0 * np.minimum(p, 1.0 - p), 1.0)
    dof = np.where(known, df, 1.0)
    low, high = np.zeros_like(tail), np.ones_like(tail)
    while True:
        short = t_two_sided_values(high, dof) > tail
        if not short.any() or high.max() > 1e300:
            break
        high = np.where(short, high * 2.0, high)
    for _ in range(200):
        mid = (low + high) / 2.0
        above = t_two_sided_values(mid, dof) > tail
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    size = (low + high) / 2.0
    return np.where(known, np.where(p < 0.5, -size, size), np.nan)


def _nullable(values: np.ndarray) -> pd.Series:
    series = pd.Series(values, dtype="float64")
    return series.where(series.notna(), None).astype("Float64")


@F.pandas_udf(DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_cdf_values(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_two_sided_values(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_ppf_values(p.to_numpy(float), df.to_numpy(float)))


def kolmogorov_sf(x: Column, terms: int = 100) -> Column:
    """Upper tail of the Kolmogorov distribution.

    The alternating series converges fast for large ``x``; below 1 the theta
    transform of the same function is used.
    """
    zero = F.lit(0.0)
    steps = F.sequence(F.lit(1), F.lit(terms))
    alternating = F.aggregate(
        steps, zero, lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x)
    )
    theta = F.aggregate(
        steps,
        zero,
        lambda acc, k: acc + F.exp(-((2 * k - 1) * (2 * k - 1)) * F.lit(math.pi**2) / (8.0 * x * x)),
    )
    low = 1.0 - F.lit(math.sqrt(2.0 * math.pi)) / x * theta
    return F.when(x <= 0, F.lit(1.0)).when(x < 1, low).otherwise(2.0 * alternating)
