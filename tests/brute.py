"""Plain versions of what the library computes another way."""

from __future__ import annotations

import math

import numpy as np

from tallyloom.functions import stats


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.asarray(x, np.float64).copy(), np.zeros_like(np.asarray(x, np.float64))
    for _ in range(10):
        low = x < 10
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def likelihood_fit(y: np.ndarray, n: np.ndarray, w: np.ndarray, steps: int = 80) -> tuple[float, float, str]:
    """(mean, concentration, method): beta-binomial maximum likelihood in log parameters, else the moment fit.

    Ascent by gradient steps with backtracking; a fit at a bound (log 1e-3, log 1e6) or unsettled falls back.
    """
    mean, conc = stats.moment_fit(y, n, w)
    lo, hi = math.log(1e-3), math.log(1e6)
    t = np.clip(np.log([mean * conc, (1 - mean) * conc]), lo, hi)

    def value(t):
        a, b = np.exp(t)
        return float((w * (stats.log_gamma(y + a) + stats.log_gamma(n - y + b) - stats.log_gamma(n + a + b))).sum() + w.sum() * float((stats.log_gamma(np.array([a + b])) - stats.log_gamma(np.array([a])) - stats.log_gamma(np.array([b])))[0]))

    def slope(t):
        a, b = np.exp(t)
        d = _digamma
        common = d(np.array([a + b]))[0] * w.sum() - (w * d(n + a + b)).sum()
        return np.array([a * ((w * d(y + a)).sum() - d(np.array([a]))[0] * w.sum() + common), b * ((w * d(n - y + b)).sum() - d(np.array([b]))[0] * w.sum() + common)])

    at, g, settled = value(t), slope(t), False
    for _ in range(steps):
        h, eps = np.zeros((2, 2)), 1e-4
        for j in range(2):
            e = np.zeros(2)
            e[j] = eps
            h[:, j] = (slope(t + e) - slope(t - e)) / (2 * eps)
        h = (h + h.T) / 2
        try:
            step = -np.linalg.solve(h, g) if np.linalg.eigvalsh(h).max() < 0 else g / max(1.0, np.abs(g).max())
        except np.linalg.LinAlgError:
            break
        scale = min(1.0, 3 / max(1e-12, np.abs(step).max()))
        for _ in range(30):
            new = np.clip(t + scale * step, lo, hi)
            now = value(new)
            if now >= at - 1e-12:
                break
            scale /= 2
        moved, t, at = np.abs(new - t).max(), new, now
        g = slope(t)
        if moved < 1e-7:
            settled = True
            break
    if not settled or (t <= lo + 1e-6).any() or (t >= hi - 1e-6).any():
        return mean, conc, "moment"
    a, b = np.exp(t)
    return a / (a + b), a + b, "likelihood"
