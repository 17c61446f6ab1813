"""Numeric functions: columns where closed forms exist, Arrow-batched numpy where sums are needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
CHI2_9_95 = 16.918977604620444  # fixed value: 95 % point of chi-square with 9 degrees of freedom


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def beta_binomial_variance(n: Column, a: Column, b: Column) -> Column:
    s = a + b
    return n * a * b * (s + n) / (s * s * (s + 1))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument above 10; for x > 0."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        shift[low] -= np.log(x[low])
        x[low] += 1
    i = 1 / x
    i2 = i * i
    series = i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def log_pmf(n: int, a: float, b: float) -> np.ndarray:
    """Beta-binomial log probabilities of 0 .. n, by sums of logarithms (log-gamma at steps of one)."""
    j = np.arange(n, dtype=np.float64)
    rise = lambda x: np.concatenate([[0.0], np.cumsum(np.log(j + x))])  # noqa: E731  log-gamma(k + x) - log-gamma(x)
    factorial = rise(1.0)
    choose = factorial[n] - factorial - factorial[::-1]
    return choose + rise(a) + rise(b)[::-1] - rise(a + b)[n]


def tails(y: int, n: int, a: float, b: float) -> tuple[float, float, float]:
    """(two-sided p: twice the smaller tail, at most 1; bounds of the central 95 %)."""
    cdf = np.cumsum(np.exp(log_pmf(n, a, b)))
    lower, upper = cdf[y], 1 - (cdf[y - 1] if y else 0.0)
    return min(1.0, 2 * max(0.0, min(lower, upper))), float(np.searchsorted(cdf, 0.025)), float(min(n, np.searchsorted(cdf, 0.975)))


def beta_binomial_tail(y: Column, n: Column, mean: Column, concentration: Column) -> Column:
    """Struct (p, low, high): two-sided tail and central interval of y out of n; nulls give nulls."""
    return F.pandas_udf(_tail, "p double, low double, high double")(y, n, mean, concentration)


def _tail(y: pd.Series, n: pd.Series, mean: pd.Series, concentration: pd.Series) -> pd.DataFrame:
    """Equal inputs are computed once."""
    memo: dict[tuple, tuple] = {}
    out = []
    for key in zip(y, n, mean, concentration, strict=True):
        if any(pd.isna(v) for v in key):
            out.append((None, None, None))
            continue
        if key not in memo:
            memo[key] = tails(int(key[0]), int(key[1]), key[2] * key[3], (1 - key[2]) * key[3])
        out.append(memo[key])
    return pd.DataFrame(out, columns=["p", "low", "high"], dtype="float64")


def chi2_sf_9(x: Column) -> Column:
    """Upper tail of chi-square with 9 degrees of freedom: the closed form for odd degrees, erfc by its expansion."""
    return F.pandas_udf(_chi2_9, "double")(x)


def _chi2_9(x: pd.Series) -> pd.Series:
    def one(v):
        if v is None or math.isnan(v):
            return None
        h, s, term = v / 2, 0.0, math.sqrt(v / 2) / math.gamma(1.5)
        for j in range(4):
            s += term
            term *= h / (j + 1.5)
        return math.erfc(math.sqrt(h)) + math.exp(-h) * s

    return x.map(one)


def _binomial_cdf(k: int, n: int, p: float) -> float:
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    i = np.arange(k + 1, dtype=np.float64)
    g = log_gamma
    return float(np.exp(g(np.array([n + 1.0])) - g(i + 1) - g(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact bounds of a binomial share, by bisection."""
    alpha = (1 - level) / 2

    def solve(f):
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: 1 - _binomial_cdf(k - 1, n, p) < alpha)
    high = 1.0 if k == n else solve(lambda p: _binomial_cdf(k, n, p) > alpha)
    return low, high


def binomial_bounds(k: Column, n: Column) -> Column:
    """Struct (low, high): exact 95 % bounds of k out of n; (0, 1) for n = 0. For small results."""
    return F.pandas_udf(_bounds, "low double, high double")(k, n)


def _bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    out = [(0.0, 1.0) if not m else clopper_pearson(int(a), int(m)) for a, m in zip(k, n, strict=True)]
    return pd.DataFrame(out, columns=["low", "high"])


def moment_fit(y: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(mean, concentration) by moments of states (y, n) that stand w times: rates count by how often they stand."""
    mean = float(np.clip(((w * y).sum() + 0.5) / ((w * n).sum() + 1), 1e-6, 1 - 1e-6))
    var = float((w * (y / n - mean) ** 2).sum() / w.sum())
    return mean, float(np.clip(mean * (1 - mean) / max(var, 1e-9) - 1, 1e-3, 1e6))
