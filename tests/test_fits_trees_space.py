"""Likelihood fits with rows left out, trees by doubled links, neighbours by adaptive cells: against plain versions."""

from __future__ import annotations

import math

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import likelihood, stats
from tallyloom.operators import fits, screens, trees, windows

KIND = "unit long, department long, municipality long, place long, y long, n long, eligible boolean"
LEVELS = ["department", "municipality", "place"]


def _units(count: int) -> list[tuple]:
    rng = np.random.default_rng(5)
    out = []
    for u in range(count):
        m, n = int(rng.integers(0, 6)), int(rng.integers(80, 300))
        out.append((u, m // 3, m, m * 10 + int(rng.integers(0, 3)), int(rng.binomial(n, rng.beta(6 + m, 9))), n, True))
    return out


def _hierarchy(rows: list[tuple], u: int) -> tuple[str, float, float]:
    a, keys = np.array([[r[4], r[5]] for r in rows], float), [np.array([r[k] for r in rows]) for k in (1, 2, 3)]
    for level in range(4):
        peers = np.ones(len(rows), bool) if level == 0 else np.logical_and.reduce([keys[k] == keys[k][u] for k in range(level)])
        peers[u] = False
        m = peers.sum()
        if level == 0 or m >= 2:
            mean, strength, _ = brute.likelihood_fit(a[peers, 0], a[peers, 1], np.ones(m))
            w = m / (m + 8) if level else 1
            now = (mean, strength) if level == 0 else (w * mean + (1 - w) * now[0], math.exp(w * math.log(strength) + (1 - w) * math.log(now[1])))
        if level == 1 or level == 2 and m >= 1 or level == 3 and m >= 9:
            named = (LEVELS[level - 1], *now)
    return named


@pytest.mark.parametrize("most", [512, 150])
def test_hierarchical_likelihood(spark, most):
    rows = _units(200)  # with 150, the pool of all rows is summed over tasks, by rounds
    got = {r.unit: r for r in screens.hierarchical_reference(spark.createDataFrame(rows, KIND), LEVELS, "y", "n", "eligible", most_states=most).collect()}
    for u in range(0, 200, 9):
        level, mean, strength = _hierarchy(rows, u)
        r = got[u]
        assert r.ref_level == level and abs(r.ref_mean - mean) < 1e-6 and abs(r.ref_concentration / strength - 1) < 1e-4
        p, low, high = stats.tails(r.y, r.n, r.ref_mean * r.ref_concentration, (1 - r.ref_mean) * r.ref_concentration)
        assert abs(r.p - p) < 1e-9 and r.low == low / r.n and r.high == high / r.n
    assert {r.ref_fit for r in got.values()} <= {"likelihood", "not_converged"}


def test_hierarchical_edges(spark):
    rows = [(1, 0, 0, 0, 5, 90, True), (2, 0, 0, 0, 7, 90, False)]
    got = screens.hierarchical_reference(spark.createDataFrame(rows, KIND), LEVELS, "y", "n", "eligible").collect()
    assert len(got) == 2 and all(r.ref_level is None and r.p is None for r in got)
    assert screens.hierarchical_reference(spark.createDataFrame([], KIND), LEVELS, "y", "n", "eligible").count() == 0


@pytest.mark.parametrize("share", [200, 1])
def test_municipality_likelihood(spark, monkeypatch, share):
    """share 1: sums outside by expansion only, here of small groups."""
    monkeypatch.setattr(fits, "EXACT_SHARE", share)
    rows = [(u, d, u % 150 if share == 1 else m, p, y, n, e) for u, d, m, p, y, n, e in _units(600)]
    rows = [(u, 0, m, p, y, n, e) for u, _, m, p, y, n, e in rows]
    got = screens.municipality_left_out(spark.createDataFrame(rows, KIND), "department", "municipality", "y", "n").collect()
    a, key = np.array([[r[4], r[5]] for r in rows], float), np.array([r[2] for r in rows])
    assert len(got) == len(set(key))
    for r in got[::17] if share == 1 else got:
        mean, strength, how = brute.likelihood_fit(*a[key != r.municipality].T, np.ones((key != r.municipality).sum()))
        assert r.fit == how == "likelihood" and abs(r.expected / r.n - mean) < 1e-7
        alpha, beta = mean * strength, (1 - mean) * strength
        assert abs(r.variance / (r.n * alpha * beta * (strength + r.n) / (strength**2 * (strength + 1))) - 1) < 1e-4
    one = spark.createDataFrame(rows[:1], KIND)
    assert screens.municipality_left_out(one, "department", "municipality", "y", "n").first().expected is None
    assert screens.municipality_left_out(one.limit(0), "department", "municipality", "y", "n").count() == 0


def test_many_pools_at_once():
    rng = np.random.default_rng(3)
    pools = []
    for k in range(40):
        n = rng.integers(80, 120, int(rng.integers(1, 30)))
        y = rng.binomial(n, rng.beta(8, 12, len(n))) if k % 3 else (n * 0.4).astype(int)
        pools.append(np.unique(np.stack([y, n], 1), axis=0, return_counts=True))
    y, n = np.concatenate([p[0] for p in pools]).T.astype(float)
    w = np.concatenate([p[1] for p in pools]).astype(float)
    first = np.cumsum([0] + [len(p[1]) for p in pools])[:-1]
    want = [o for s, c in pools for o in likelihood.left_out(*s.T.astype(float), c.astype(float))]
    for a, b in zip(likelihood.left_out_many(first, y, n, w), want, strict=True):
        assert a[2] == b[2] and (a[0] is None or abs(a[0] - b[0]) < 1e-7 and abs(a[1] / b[1] - 1) < 1e-5)


def test_polygammas():
    x = np.array([0.01, 0.7, 3.0, 25.0, 1e5])
    d, t, q = likelihood.polygammas(x)
    e = 1e-4 * x
    g = lambda v: likelihood.polygammas(v)
    assert np.allclose((stats.log_gamma(x + e) - stats.log_gamma(x - e)) / (2 * e), d, rtol=1e-5, atol=1e-6)
    assert np.allclose((g(x + e)[0] - g(x - e)[0]) / (2 * e), t, rtol=1e-5) and np.allclose((g(x + e)[1] - g(x - e)[1]) / (2 * e), q, rtol=1e-5)


def test_trees(spark):
    rng = np.random.default_rng(1)
    links = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]  # a chain of 40
    links += [(f"m{i}", f"n{int(rng.integers(40))}") for i in range(20)]
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below", "c1"), ("self", "self"), ("orphan", "gone"), (None, "n1"), ("n5", "n4")]
    df = spark.createDataFrame(links, "id string, parent_id string")
    up = {i: p for i, p in links if i}

    def way(i):
        out = [i]
        while up.get(out[-1]) in up and len(out) < 100:
            out.append(up[out[-1]])
        return out[::-1]

    lost = {"c1", "c2", "c3", "below", "self"}
    assert {r.id for r in trees.cycles(df).collect()} == lost
    got: dict = {}
    for r in trees.paths(df).collect():
        got.setdefault(r.id, {})[r.depth] = r.ancestor
    assert set(got) == set(up) - lost
    for i, path in got.items():
        assert [path[k] for k in range(len(path))] == way(i)
    for root in ("n0", "n17", "m3", "orphan", "nothing"):
        want = {i: way(i).index(i) - way(i).index(root) for i in set(up) - lost if root in way(i)}
        assert {r.id: r.depth for r in trees.descend(df, root).collect()} == want
    assert {r.id for r in trees.descend(df, "c1").collect()} == {"c1", "c2", "c3", "below"}
    with pytest.raises(ValueError, match="several parents"):
        trees.paths(spark.createDataFrame([("a", "b"), ("a", "c")], "id string, parent_id string"))
    assert trees.paths(df.limit(0)).count() == 0 and trees.descend(df.limit(0), "x").count() == 0


def test_nested_sets_of_links(spark):
    rng = np.random.default_rng(2)
    up = {i: int(rng.integers(i)) if i % 30 else None for i in range(1, 120)} | {0: None}
    got = {r.id: (r.tree_left, r.tree_right) for r in windows.nested_sets_by_links(spark.createDataFrame(list(up.items()), "id long, parent_id long")).collect()}
    kids: dict = {}
    for i, p in sorted(up.items()):
        kids.setdefault(p, []).append(i)
    want, clock = {}, 0

    def walk(i):
        nonlocal clock
        clock += 1
        left = clock
        for k in kids.get(i, []):
            walk(k)
        clock += 1
        want[i] = (left, clock)

    for i in kids[None]:
        walk(i)
    assert got == want


def test_numbered_in_ranges(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else f"s{i % 3}", i) for i in range(500)], "s string, i long").repartition(5)
    got = trees.numbered(df, ["s"], ["i"], "k").collect()
    assert len(got) == 500 and all(r.k == r.i // 3 + 1 for r in got)


@pytest.mark.parametrize("shape", ["even", "city", "one_place"])
def test_neighbours(spark, shape):
    rng = np.random.default_rng(7)
    at = {"even": rng.random((150, 2)) * 0.8, "city": np.concatenate([rng.random((120, 2)) * 0.002, rng.random((30, 2)) * 0.6]), "one_place": np.concatenate([np.full((60, 2), 0.1), rng.random((20, 2)) * 0.2])}[shape] + [57.0, 9.9]
    rows = [(i, "ab"[i % 2], float(a), float(b)) for i, (a, b) in enumerate(at)] + [(1000, "a", None, 1.0), (1001, None, 57.0, 10.0)]
    got: dict = {}
    for r in screens.neighbours(spark.createDataFrame(rows, "u long, g string, la double, lo double"), "u", "g", "la", "lo", k=4).collect():
        got.setdefault(r.u, {})[r.n] = (r.other, r.km)

    def km(p, q):
        h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * stats.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    sound = [r for r in rows if r[0] < 1000]
    for p in sound:
        near = sorted((km(p, q), q[0]) for q in sound if q[1] == p[1] and q[0] != p[0])
        want = [(d, o) for d, o in near if d <= 20][:4]
        mine = got.get(p[0], {})
        assert len(mine) == len(want)
        for n, (d, o) in enumerate(want, 1):
            assert abs(mine[n][1] - d) < 1e-9 and (mine[n][0] == o or abs(km(p, rows[mine[n][0]]) - d) < 1e-9)


def test_spatial_signals(spark):
    rng = np.random.default_rng(5)
    base = dict(grain="row", g="m", acc=10.0, cross=False)
    rows = [dict(base, row=i, place=None, la=1 + (i % 11) / 100, lo=1 + (i // 11) / 100, r=float(rng.normal()) + (6 if i in (0, 1, 11, 12) else 0)) for i in range(121)]
    rows += [dict(base, row=200 + i, place=1, grain="place", la=1.005, lo=1.005, r=float(i)) for i in range(3)]  # one unit
    rows += [dict(base, row=300 + i, place=2, grain="place", la=1.0 + i / 50, lo=1.5, r=1.0) for i in range(2)]  # at odds
    rows += [dict(base, row=400 + i, place=None, la=1.055, lo=1.055, r=1.0) for i in range(2)]  # share coordinates
    rows += [dict(base, row=500, place=None, la=None, lo=1.0, r=1.0), dict(base, row=501, place=None, la=1.0, lo=1.0, r=1.0, acc=900.0), dict(base, row=502, place=None, la=1.0, lo=1.0, r=1.0, cross=True)]
    rows += [dict(base, row=600, place=None, la=5.0, lo=5.0, r=1.0)] + [dict(base, row=700 + i, place=None, g="small", la=2 + i / 100, lo=2.0, r=float(i % 3)) for i in range(6)]
    df = spark.createDataFrame([tuple(r[c] for c in ("row", "place", "grain", "g", "la", "lo", "r", "acc", "cross")) for r in rows], "row long, place long, grain string, g string, la double, lo double, r double, acc double, cross boolean")
    got = {r.row: r for r in screens.spatial_signals(df, *df.columns).collect()}
    assert len(got) == len(rows)
    want = {500: 0, 501: 0, 502: 0, 300: 1, 301: 1, 400: 2, 401: 2, 201: 3, 202: 3, 600: 4, 700: 5}
    assert all(got[k].reason == screens.EXCLUSIONS[e] and got[k].p is None for k, e in want.items())
    tested = [r for r in got.values() if r.reason is None]
    assert len(tested) == 122 and got[200].reason is None and sorted(r["rank"] for r in tested) == list(range(1, 123))
    assert got[0].flag and got[0].kind == "cluster" and all(0 < r.p <= 1 for r in tested)
    plain = {r.u: r for r in screens.spatial_screen(screens.located_units(df, *df.columns)[0].withColumnRenamed("unit", "u"), "u", "g", "la", "lo", "r").collect()}
    assert all(abs(plain[r.unit].local_i - r.local_i) < 1e-12 and plain[r.unit].p == r.p for r in tested)


def test_seeds_follow_the_data(spark):
    a, b = (screens._seed("m", 0, np.array([1.0, x])).random() for x in (2.0, 3.0))
    assert a != b and a == screens._seed("m", 0, np.array([1.0, 2.0])).random() != screens._seed("k", 0, np.array([1.0, 2.0])).random()


def test_nothing_stays_cached(spark):
    df = spark.createDataFrame([("f", i, i / 100) for i in range(50)], "f string, id int, p double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert windows.by_adjust(df, "f", "p", "id").where(F.col("q") <= 1).count() == 50
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize("shape", ["uniform", "heavy", "few"])
def test_drawn_statistics(shape):
    """Maxima and counts of drawn statistics against the formula, unit by unit, over batches and chunks; untested units and ties included."""
    rng = np.random.default_rng(len(shape))
    n = 7 if shape == "few" else 150
    x = rng.standard_cauchy(n) if shape == "heavy" else np.round(rng.random(n), 2)
    others = [rng.choice(np.delete(np.arange(n), i), int(rng.integers(3, 6)), replace=False).tolist() for i in range(n)]
    tested = rng.random(n) < 0.8
    pdf = pd.DataFrame({"group": 1, "unit": np.arange(n), "residual": x, "others": others, "tested": tested, "start": 512, "size": 300, "batch": 128})
    z, v = x - x.mean(), x.var()
    one = lambda values: np.array([abs(values[i] * np.mean([values[j] for j in others[i]])) / v for i in np.flatnonzero(tested)])
    drawn = np.concatenate([screens._seed(1, at, x).permuted(np.tile(z, (size, 1)), axis=1) for at, size in ((512, 128), (640, 128), (768, 44))])
    every = np.array([one(d) for d in drawn])
    top, reached = screens._top_moran(pdf), screens._unit_moran(pdf)
    assert top["permutation"].tolist() == list(range(512, 812)) and np.allclose(top["top"], every.max(1), rtol=1e-12, atol=0)
    assert reached["unit"].tolist() == np.flatnonzero(tested).tolist()
    assert (reached["reached"].to_numpy() == (every >= one(z) - 1e-12).sum(0)).all()
    none = pdf.assign(tested=False)
    assert (screens._top_moran(none)["top"] == 0).all() and len(screens._unit_moran(none)) == 0
