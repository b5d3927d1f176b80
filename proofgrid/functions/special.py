"""Tail probabilities and quantiles that Spark SQL lacks, as NumPy functions and Arrow UDFs over them.

They are applied to one row for each test or contributor, never to raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _lgamma(x) -> np.ndarray:
    return np.array(lgamma(np.asarray(x, float)), float)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, np.clip(x, 0.0, 1.0)))
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.where((x > 0) & (x < 1), np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a, 0.0)
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    low = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.clip(np.where(swap, 1 - low, low), 0.0, 1.0)


def gamma_inc(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, np.maximum(x, 0.0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.where(x > 0, np.exp(a * np.log(x) - x - _lgamma(a)), 0.0)
    term = 1 / a
    total = term.copy()
    for k in range(1, 2000):
        term = term * x / (a + k)
        total = total + term
        if np.all((np.abs(term) < np.abs(total) * 1e-16) | (x > a + 1)):
            break
    tiny = 1e-300
    b = x + 1 - a
    c = np.full_like(x, 1 / tiny)
    d = 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for k in range(1, 2000):
        num = -k * (k - a)
        b = b + 2
        d = num * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + num / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-15) | (x <= a + 1)):
            break
    return np.clip(np.where(x <= a + 1, front * total, 1 - front * h), 0.0, 1.0)


def binomial_sf(k, n, p) -> np.ndarray:
    """P(X >= k), X ~ Binomial(n, p), with p held away from 0 and 1."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.clip(np.asarray(p, float), 1e-12, 1 - 1e-12))
    inside = (k > 0) & (k <= n)
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, beta_inc(np.where(inside, k, 1), np.where(inside, n - k + 1, 1), p)))


def poisson_sf(k, mean) -> np.ndarray:
    """P(X >= k), X ~ Poisson(mean)."""
    k = np.asarray(k, float)
    return np.where(k <= 0, 1.0, gamma_inc(np.maximum(k, 1), mean))


def beta_sf(x, a, b) -> np.ndarray:
    return beta_inc(b, a, 1 - np.asarray(x, float))


def beta_ppf(q, a, b) -> np.ndarray:
    """Quantile of Beta(a, b), by bisection."""
    q, a, b = (np.array(v, float) for v in np.broadcast_arrays(q, a, b))
    lo, hi = np.zeros_like(q), np.ones_like(q)
    for _ in range(100):
        mid = (lo + hi) / 2
        below = beta_inc(a, b, mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def beta_binomial_ppf(q: float, n: int, a: float, b: float) -> int:
    """Least k with P(X <= k) >= q, X ~ BetaBinomial(n, a, b)."""
    k = np.arange(n + 1, dtype=float)
    log = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + _lgamma(k + a) + _lgamma(n - k + b) - _lgamma(n + a + b) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return int(min(n, np.searchsorted(np.cumsum(np.exp(log)), q - 1e-12)))


def chi2_sf(x, df) -> np.ndarray:
    return 1 - gamma_inc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_sf(z) -> np.ndarray:
    return 0.5 * np.array(np.frompyfunc(math.erfc, 1, 1)(np.asarray(z, float) / math.sqrt(2)), float)


def kolmogorov_sf(d, n, m) -> np.ndarray:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    d, n, m = (np.asarray(v, float) for v in (d, n, m))
    t = d * np.sqrt(n * m / (n + m))
    j = np.arange(1, 101)[:, None]
    total = 2 * ((-1.0) ** (j - 1) * np.exp(-2 * j**2 * np.atleast_1d(t) ** 2)).sum(0)
    return np.where(np.atleast_1d(t) < 0.2, 1.0, np.clip(total, 0, 1))


def pareto_profile(mean_log: Callable[[np.ndarray], np.ndarray], mean: float, top: float) -> tuple[float, float]:
    """(shape, scale) of a generalised Pareto fit: likelihood profiled over theta = shape / scale on a refined grid.

    The data enter by their mean, their maximum and ``mean_log``, the mean of log1p(theta * x) for each of the thetas.
    """
    lo, hi = -0.999 / top, 20 / max(mean, 1e-300)
    for _ in range(8):
        grid = np.linspace(lo, hi, 201)
        shape = mean_log(grid)
        flat = np.abs(grid) < 1e-12
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(flat, mean, shape / grid)
            loss = np.log(scale) + np.where(flat, 1.0, 1 + shape)
        at = int(np.where(np.isfinite(loss) & (scale > 0), loss, np.inf).argmin())
        lo, hi = grid[max(0, at - 1)], grid[min(200, at + 1)]
    return float(shape[at]), float(scale[at])


def pareto_tail(exceed: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of the fit to exceedances in memory."""
    x = np.asarray(exceed, float)
    return pareto_profile(lambda theta: np.log1p(np.outer(theta, x)).mean(1), float(x.mean()), float(x.max()))


@F.pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_sf(k, n, p))


@F.pandas_udf(T.DoubleType())
def poisson_tail(k: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series(poisson_sf(k, mean))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x, df))


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return pd.Series(normal_sf(z))


@F.pandas_udf(T.DoubleType())
def ks_pvalue(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(kolmogorov_sf(d, n, m))


@F.pandas_udf(T.DoubleType())
def beta_tail(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_sf(x, a, b))


@F.pandas_udf(T.DoubleType())
def beta_quantile(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_ppf(q, a, b))


@F.pandas_udf(T.LongType())
def beta_binomial_quantile(q: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([beta_binomial_ppf(*r) for r in zip(q, n, a, b, strict=True)], dtype="int64")


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(k: pd.Series, members: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    """P(X >= k) of ``members`` draws from ``total`` rows of which ``marked`` have the value (Fisher, greater)."""
    out = []
    for a, m, w, n in zip(k.astype(int), members.astype(int), marked.astype(int), total.astype(int), strict=True):
        x = np.arange(max(a, m + w - n, 0), min(m, w) + 1, dtype=float)
        log = _lgamma(w + 1) - _lgamma(x + 1) - _lgamma(w - x + 1) + _lgamma(n - w + 1) - _lgamma(m - x + 1) - _lgamma(n - w - m + x + 1) - (_lgamma(n + 1) - _lgamma(m + 1) - _lgamma(n - m + 1))
        out.append(float(min(1.0, np.exp(log).sum())))
    return pd.Series(out)
