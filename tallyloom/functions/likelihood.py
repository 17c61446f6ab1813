"""Beta-binomial maximum likelihood over states (y of n, w times) in log parameters u = log a, v = log b.

Sums over states have nine parts: with A = y + a against a, B = n - y + b against b, C = a + b against n + a + b, the
differences of digamma, trigamma and tetragamma. Everything a Newton step needs follows from them, and a row is left out by
taking its own parts away. A parameter that its bound holds stays there while the slope points outwards.
"""

from __future__ import annotations

import math

import numpy as np

from tallyloom.functions import stats

LOW, HIGH = math.log(1e-3), math.log(1e6)
PARTS = ("a1", "b1", "c1", "a2", "b2", "c2", "a3", "b3", "c3")
LEAST_MOVE = 1e-8
CELLS = 1 << 22  # cells of a matrix of fits by values


def polygammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digamma, trigamma, tetragamma for x > 0: moved above 10, then their series."""
    x = np.array(x, np.float64)
    d, t, q = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        i = 1 / x[low]
        d[low] -= i
        t[low] += i * i
        q[low] -= 2 * i * i * i
        x[low] += 1
    i = 1 / x
    i2 = i * i
    d += np.log(x) - 0.5 * i - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 / 240)))
    t += i + i2 / 2 + i * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 / 30)))
    q += -i2 * (1 + i + i2 * (1 / 2 - i2 * (1 / 6 - i2 * (1 / 6 - i2 * 3 / 10))))
    return d, t, q


def parts(y: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The nine parts of single rows, by row; all arguments broadcast."""
    up, down, both = polygammas(y + a), polygammas(n - y + b), polygammas(n + a + b)
    of_a, of_b, of_ab = polygammas(a), polygammas(b), polygammas(a + b)
    return np.stack([np.broadcast_to(p, np.broadcast(y, a).shape) for k in range(3) for p in (up[k] - of_a[k], down[k] - of_b[k], of_ab[k] - both[k])], -1)


def slopes(p: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, Hessian as 11 12 22, third derivatives as 111 112 122 222) in log parameters, from sums of parts."""
    a, b = np.exp(u), np.exp(v)
    a1, b1, c1, a2, b2, c2, a3, b3, c3 = np.moveaxis(p, -1, 0)
    la, lb, laa, lbb, lab = a1 + c1, b1 + c1, a2 + c2, b2 + c2, c2
    g = np.stack([a * la, b * lb], -1)
    h = np.stack([a * a * laa + a * la, a * b * lab, b * b * lbb + b * lb], -1)
    t = np.stack([a**3 * (a3 + c3) + 3 * a * a * laa + a * la, a * a * b * c3 + a * b * lab, a * b * b * c3 + a * b * lab, b**3 * (b3 + c3) + 3 * b * b * lbb + b * lb], -1)
    return g, h, t


def moved(g: np.ndarray, h: np.ndarray, t: np.ndarray, du: np.ndarray, dv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian a little further on, by the expansion around where they were taken."""
    g1 = g[..., 0] + h[..., 0] * du + h[..., 1] * dv + (t[..., 0] * du * du + 2 * t[..., 1] * du * dv + t[..., 2] * dv * dv) / 2
    g2 = g[..., 1] + h[..., 1] * du + h[..., 2] * dv + (t[..., 1] * du * du + 2 * t[..., 2] * du * dv + t[..., 3] * dv * dv) / 2
    h11, h12, h22 = h[..., 0] + t[..., 0] * du + t[..., 1] * dv, h[..., 1] + t[..., 1] * du + t[..., 2] * dv, h[..., 2] + t[..., 2] * du + t[..., 3] * dv
    return np.stack([g1, g2], -1), np.stack([h11, h12, h22], -1)


def step(u: np.ndarray, v: np.ndarray, g: np.ndarray, h: np.ndarray, longest: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """The next (u, v) of each fit: Newton where the likelihood is concave, uphill elsewhere, within the bounds."""
    g1, g2 = g[..., 0], g[..., 1]
    h11, h12, h22 = h[..., 0], h[..., 1], h[..., 2]
    held1 = (u >= HIGH) & (g1 > 0) | (u <= LOW) & (g1 < 0)
    held2 = (v >= HIGH) & (g2 > 0) | (v <= LOW) & (g2 < 0)
    det = h11 * h22 - h12 * h12
    concave = (det > 0) & (h11 < 0)
    safe = np.where(concave, det, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        alone1 = np.where(h11 < 0, -g1 / h11, np.sign(g1) * 0.5)
        alone2 = np.where(h22 < 0, -g2 / h22, np.sign(g2) * 0.5)
        s1 = np.where(concave, (h12 * g2 - h22 * g1) / safe, np.sign(g1) * 0.5)
        s2 = np.where(concave, (h12 * g1 - h11 * g2) / safe, np.sign(g2) * 0.5)
    s1 = np.where(held1, 0.0, np.where(held2, alone1, s1))
    s2 = np.where(held2, 0.0, np.where(held1, alone2, s2))
    far = np.minimum(1.0, longest / np.maximum(1e-12, np.maximum(np.abs(s1), np.abs(s2))))
    return np.clip(u + far * s1, LOW, HIGH), np.clip(v + far * s2, LOW, HIGH)


def start(mean: np.ndarray, concentration: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.clip(np.log(mean * concentration), LOW, HIGH), np.clip(np.log((1 - mean) * concentration), LOW, HIGH)


class Sums:
    """Sums of parts over a pool's states at many parameters: digammas are taken at distinct values only."""

    def __init__(self, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> None:
        self.total = w.sum()
        self.values = [np.unique(x, return_inverse=True) for x in (y, n - y, n)]
        self.weights = [np.bincount(k, w, len(x)) for x, k in self.values]

    def at(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty((len(u), 9))
        rows = max(1, CELLS // max(len(x) for x, _ in self.values))
        for i in range(0, len(u), rows):
            a, b = np.exp(u[i : i + rows]), np.exp(v[i : i + rows])
            for j, (own, sign) in enumerate(((a, 1), (b, 1), (a + b, -1))):
                x = self.values[j][0]
                over, base = polygammas(x[None, :] + own[:, None]), polygammas(own)
                for k in range(3):
                    out[i : i + rows, 3 * k + j] = sign * (over[k] @ self.weights[j] - self.total * base[k])
        return out


def _fit(sums: Sums, own: np.ndarray | None, y: np.ndarray, n: np.ndarray, u: np.ndarray, v: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton from (u, v) for many fits, the row (y, n) of each left out where own is given; (u, v, settled)."""
    settled = np.zeros(len(u), bool)
    for _ in range(steps):
        go = np.flatnonzero(~settled)
        if not len(go):
            break
        p = sums.at(u[go], v[go])
        if own is not None:
            p = p - parts(y[go], n[go], np.exp(u[go]), np.exp(v[go]))
        g, h, _ = slopes(p, u[go], v[go])
        new_u, new_v = step(u[go], v[go], g, h)
        settled[go] = np.maximum(np.abs(new_u - u[go]), np.abs(new_v - v[go])) < LEAST_MOVE
        u[go], v[go] = new_u, new_v
    return u, v, settled


def _named(u: float, v: float, settled: bool, fallback: tuple[float, float]) -> tuple[float, float, str]:
    if not settled:
        return (*fallback, "moment")
    a, b = math.exp(u), math.exp(v)
    return a / (a + b), a + b, "boundary" if min(u, v) <= LOW + 1e-5 or max(u, v) >= HIGH - 1e-5 else "likelihood"


def whole_fit(y: np.ndarray, n: np.ndarray, w: np.ndarray, steps: int = 80) -> tuple[float, float, str]:
    """(mean, concentration, likelihood, boundary or moment) of a pool."""
    mean, strength = stats.moment_fit(y, n, w)
    u, v, settled = _fit(Sums(y, n, w), None, y, n, *(np.atleast_1d(x) for x in start(np.array(mean), np.array(strength))), steps)
    return _named(u[0], v[0], settled[0], (mean, strength))


def left_out(y: np.ndarray, n: np.ndarray, w: np.ndarray, steps: int = 40) -> list[tuple[float | None, float | None, str]]:
    """Fits of a pool with one row of each state left out, all at once, from the whole pool's; a lone row has none."""
    if w.sum() <= 1:
        return [(None, None, "none")] * len(y)
    sums = Sums(y, n, w)
    mean, strength = stats.moment_fit(y, n, w)
    u, v, _ = _fit(sums, None, y, n, *(np.atleast_1d(x) for x in start(np.array(mean), np.array(strength))), 80)
    u, v, settled = _fit(sums, np.ones(1), y, n, np.full(len(y), u[0]), np.full(len(y), v[0]), steps)
    out = []
    for i in range(len(y)):
        rest = w.copy()
        fallback = (0.0, 0.0)
        if not settled[i]:
            rest[i] -= 1
            fallback = stats.moment_fit(y[rest > 0], n[rest > 0], rest[rest > 0])
        out.append(_named(u[i], v[i], settled[i], fallback))
    return out


def _newton(u: np.ndarray, v: np.ndarray, sums_of, steps: int) -> np.ndarray:
    """Moves many fits, in place, until they settle; sums_of(which, u, v) gives their sums of parts. Which have settled."""
    settled = np.zeros(len(u), bool)
    for _ in range(steps):
        go = np.flatnonzero(~settled)
        if not len(go):
            break
        g, h, _ = slopes(sums_of(go, u[go], v[go]), u[go], v[go])
        new_u, new_v = step(u[go], v[go], g, h)
        settled[go] = np.maximum(np.abs(new_u - u[go]), np.abs(new_v - v[go])) < LEAST_MOVE
        u[go], v[go] = new_u, new_v
    return settled


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0] - 1, 0 .. counts[1] - 1, and so on."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def left_out_many(first: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, steps: int = 40) -> list[tuple[float | None, float | None, str]]:
    """`left_out` of many small pools at once; first: where each pool's states begin."""
    size = np.diff(np.append(first, len(y)))
    total = np.add.reduceat(w, first)
    pool = np.repeat(np.arange(len(first)), size)
    mean = np.clip((np.add.reduceat(w * y, first) + 0.5) / (np.add.reduceat(w * n, first) + 1), 1e-6, 1 - 1e-6)
    var = np.add.reduceat(w * (y / n - mean[pool]) ** 2, first) / total
    u, v = start(mean, np.clip(mean * (1 - mean) / np.maximum(var, 1e-9) - 1, 1e-3, 1e6))

    def summed(at: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of parts over the states `at`, `count` of them for each fit with parameters a, b and `rows` rows."""
        begin, fit = np.cumsum(count) - count, np.repeat(np.arange(len(a)), count)
        out = np.empty((len(a), 9))
        for j, (x, own, sign) in enumerate(((y[at], a, 1), (n[at] - y[at], b, 1), (n[at], a + b, -1))):
            for k, (over, base) in enumerate(zip(polygammas(x + own[fit]), polygammas(own), strict=True)):
                out[:, 3 * k + j] = sign * (np.add.reduceat(over * weight, begin) - rows * base)
        return out

    def whole(go: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        at = np.repeat(first[go], size[go]) + _ragged(size[go])
        return summed(at, size[go], np.exp(u), np.exp(v), w[at], total[go])

    def without(go: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty((len(go), 9))
        ends = np.cumsum(size[pool[go]])
        i = 0
        while i < len(go):  # about CELLS states at a time
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CELLS, side="right")))
            some, count = go[i:j], size[pool[go[i:j]]]
            at = np.repeat(first[pool[some]], count) + _ragged(count)
            left = w[at] - (at == np.repeat(some, count))
            out[i:j] = summed(at, count, np.exp(u[i:j]), np.exp(v[i:j]), left, total[pool[some]] - 1)
            i = j
        return out

    _newton(u, v, whole, 80)
    u, v = u[pool], v[pool]
    alone = total[pool] <= 1
    settled = np.zeros(len(y), bool)
    some = np.flatnonzero(~alone)
    us, vs = u[some], v[some]
    settled[some] = _newton(us, vs, lambda go, a, b: without(some[go], a, b), steps)
    u[some], v[some] = us, vs
    out: list[tuple[float | None, float | None, str]] = []
    for i in range(len(y)):
        if alone[i]:
            out.append((None, None, "none"))
        elif settled[i]:
            out.append(_named(u[i], v[i], True, (0.0, 0.0)))
        else:
            a, b = first[pool[i]], first[pool[i]] + size[pool[i]]
            rest = w[a:b] - (np.arange(a, b) == i)
            out.append((*stats.moment_fit(y[a:b][rest > 0], n[a:b][rest > 0], rest[rest > 0]), "moment"))
    return out
