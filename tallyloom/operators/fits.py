"""Beta-binomial fits of pools with a row, or a whole group, left out. Pools are histograms of states: (y, n) with a count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import likelihood as L
from tallyloom.operators import windows
from tallyloom.scratch import dropped, kept

MOST_STATES = 512  # states of a pool that one task fits; larger pools are fitted by sums over all tasks
SMALL = 64  # states of a pool that is fitted together with others
GROUP = 50_000  # states of the pools that one task fits
ROUNDS = 60
EXACT_SHARE = 200  # groups with a 200th of all rows or more (so 200 at most) get exact sums outside, others an expansion
_FIT = "fit_mean double, fit_concentration double, fit string"
_STEP = "u double, v double, move double"
_PARTS = ", ".join(f"{p} double" for p in L.PARTS)


def states(df: DataFrame, pools: list[Column], y: str, n: str) -> DataFrame:
    """pool_key, y, n, w: each row counts once in each of its pools."""
    keyed = df.select(F.explode(F.array(*pools)).alias("pool_key"), F.col(y).cast("long").alias("y"), F.col(n).cast("long").alias("n"))
    return keyed.groupBy("pool_key", "y", "n").agg(F.count("*").alias("w"))


def _numbers(pdf: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    return [pdf[c].to_numpy(np.float64) for c in columns]


def _in_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """Left-out fits of the pools of one group: small ones all at once, each larger one by its distinct values."""
    pdf = pdf.sort_values(["pool_key", "y", "n"]).reset_index(drop=True)
    keys = pdf["pool_key"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(pdf)))
    y, n, w = _numbers(pdf, "y", "n", "w")
    out: list = [None] * len(pdf)
    small = np.repeat(size <= SMALL, size)
    if small.any():
        begins = np.cumsum(size[size <= SMALL]) - size[size <= SMALL]
        for i, o in zip(np.flatnonzero(small).tolist(), L.left_out_many(begins, y[small], n[small], w[small]), strict=True):
            out[i] = o
    for a, k in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        out[a : a + k] = L.left_out(y[a : a + k], n[a : a + k], w[a : a + k])
    return pdf[["pool_key", "y", "n"]].assign(fit_mean=[o[0] for o in out], fit_concentration=[o[1] for o in out], fit=[o[2] for o in out])


def _weighted(y: pd.Series, n: pd.Series, w: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
    """Parts of states at the parameters beside them, times their counts."""
    y, n, w, u, v = (x.to_numpy(np.float64) for x in (y, n, w, u, v))
    return pd.DataFrame(L.parts(y, n, np.exp(u), np.exp(v)) * w[:, None], columns=L.PARTS)


def _stepped(u: pd.Series, v: pd.Series, p: pd.DataFrame) -> pd.DataFrame:
    a, b = u.to_numpy(np.float64), v.to_numpy(np.float64)
    g, h, _ = L.slopes(p.to_numpy(np.float64), a, b)
    new = L.step(a, b, g, h)
    return pd.DataFrame({"u": new[0], "v": new[1], "move": np.maximum(np.abs(new[0] - a), np.abs(new[1] - b))})


def _one_out(y: pd.Series, n: pd.Series, u: pd.Series, v: pd.Series, p: pd.DataFrame) -> pd.DataFrame:
    """Newton for one row less: sums of the whole pool by their expansion around its fit, the row's own exactly."""
    y, n, u0, v0 = (x.to_numpy(np.float64) for x in (y, n, u, v))
    u, v, settled = u0.copy(), v0.copy(), np.zeros(len(y), bool)
    g0, h0, t0 = L.slopes(p.to_numpy(np.float64), u0, v0)
    for _ in range(30):
        g, h = L.moved(g0, h0, t0, u - u0, v - v0)
        g1, h1, _ = L.slopes(L.parts(y, n, np.exp(u), np.exp(v)), u, v)
        new = L.step(u, v, g - g1, h - h1)
        settled = np.maximum(np.abs(new[0] - u), np.abs(new[1] - v)) < L.LEAST_MOVE
        u, v = new
        if settled.all():
            break
    return _fitted(u, v, settled)


def _fitted(u: np.ndarray, v: np.ndarray, settled: np.ndarray) -> pd.DataFrame:
    a, b = np.exp(u), np.exp(v)
    held = (np.minimum(u, v) <= L.LOW + 1e-5) | (np.maximum(u, v) >= L.HIGH - 1e-5)
    return pd.DataFrame({"fit_mean": a / (a + b), "fit_concentration": a + b, "fit": np.where(~settled, "moment", np.where(held, "boundary", "likelihood"))})


def _moment_sums() -> list[Column]:
    w, r = F.col("w"), F.col("y") / F.col("n")
    return [F.sum(F.col("y") * w).alias("sy"), F.sum(F.col("n") * w).alias("sn"), F.sum(w).alias("sk"), F.sum(r * w).alias("sr"), F.sum(r * r * w).alias("sq")]


def _sums(of: DataFrame, params: DataFrame, key: str) -> DataFrame:
    """key and the parts of its states, summed at its parameters; partial sums before the shuffle."""
    joined = of.join(params.select(key, "u", "v"), key).withColumn("p", F.pandas_udf(_weighted, _PARTS)("y", "n", "w", "u", "v"))
    return joined.groupBy(key).agg(*[F.sum(f"p.{c}").alias(c) for c in L.PARTS])


def _start(moments: DataFrame) -> DataFrame:
    mean, strength = windows.moments(*[F.col(c) for c in ("sy", "sn", "sk", "sr", "sq")])
    log = lambda x: F.greatest(F.lit(L.LOW), F.least(F.lit(L.HIGH), F.log(x)))
    return moments.withColumns({"u": log(mean * strength), "v": log((1 - mean) * strength)})


def _whole(of: DataFrame, key: str) -> DataFrame:
    """key, moment sums, u, v, move (of the last round) and the parts there, for every pool of a table of states."""
    params = kept(_start(of.groupBy(key).agg(*_moment_sums())).withColumn("move", F.lit(1.0)), "fit")
    base = [c for c in params.columns if c not in ("u", "v", "move")]
    for _ in range(ROUNDS):
        if not params.where(F.col("move") >= L.LEAST_MOVE).limit(1).count():
            break
        new = params.join(_sums(of, params, key), key).withColumn("s", F.pandas_udf(_stepped, _STEP)("u", "v", F.struct(*L.PARTS)))
        after = kept(new.select(*base, "s.u", "s.v", "s.move"), "fit")
        dropped(params)
        params = after
    return params.join(_sums(of, params, key), key)


def _crowded(of: DataFrame) -> DataFrame:
    """Left-out fits of pools with many states: whole pools by rounds of sums, then each state by itself."""
    of = kept(of, "states")
    whole = kept(_whole(of, "pool_key"), "whole-fits")
    j = of.join(whole, "pool_key").withColumn("f", F.pandas_udf(_one_out, _FIT)("y", "n", "u", "v", F.struct(*L.PARTS)))
    r = F.col("y") / F.col("n")
    mean, strength = windows.moments(F.col("sy") - F.col("y"), F.col("sn") - F.col("n"), F.col("sk") - 1, F.col("sr") - r, F.col("sq") - r * r)
    fell = (F.col("move") >= L.LEAST_MOVE) | (F.col("f.fit") == "moment")
    pick = lambda a, b, name: F.when(fell, a).otherwise(b).alias(name)
    return j.select("pool_key", "y", "n", pick(mean, F.col("f.fit_mean"), "fit_mean"), pick(strength, F.col("f.fit_concentration"), "fit_concentration"), pick(F.lit("moment"), F.col("f.fit"), "fit"))


def left_out(of: DataFrame, most: int = MOST_STATES) -> DataFrame:
    """pool_key, y, n, fit_mean, fit_concentration, fit, fit_peers: each pool's maximum likelihood without one such row.

    of: `states`. fit is likelihood, boundary (a parameter at its bound), moment (not settled) or none (no row is left).
    A pool with up to `most` states is one task's work; larger ones are summed over all tasks, round by round, and no task
    holds one.
    """
    of = kept(of, "states")
    sizes = kept(of.groupBy("pool_key").agg(F.count("*").alias("k"), F.sum("w").alias("total")), "sizes")
    sized = of.join(sizes, "pool_key")
    total = sizes.where(F.col("k") <= most).agg(F.sum("k").alias("k")).first().k or 0
    groups = max(of.sparkSession.sparkContext.defaultParallelism * 4, total // GROUP)
    dealt = sized.where(F.col("k") <= most).drop("k", "total").withColumn("group", F.pmod(F.xxhash64("pool_key"), F.lit(groups)))
    small = dealt.groupBy("group").applyInPandas(_in_task, f"pool_key string, y long, n long, {_FIT}")
    crowded = sized.where(F.col("k") > most).drop("k", "total")
    if sizes.where(F.col("k") > most).limit(1).count():
        small = small.unionByName(_crowded(crowded))
    return small.join(sizes.select("pool_key", (F.col("total") - 1).alias("fit_peers")), "pool_key")


def groups_left_out(df: DataFrame, group: list[str], y: str, n: str) -> DataFrame:
    """group, units, y, n, fit_mean, fit_concentration, fit: maximum likelihood over the rows of all other groups.

    Sums over the others are the whole table's less the group's own. The whole table's are taken at a group's own
    parameters where the group holds a 200th of all rows or more (200 groups at most), elsewhere by their expansion to the
    third order around the fit of all rows, which a smaller group moves too little for the rest to matter. Fewer than two
    rows outside: no fit.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group])
    of = kept(df.groupBy(*[F.col(c) for c in group], key.alias("key"), F.col(y).cast("long").alias("y"), F.col(n).cast("long").alias("n")).agg(F.count("*").alias("w")), "states")
    every = of.groupBy("y", "n").agg(F.sum("w").alias("w")).withColumn("one", F.lit(1))
    every = kept(every, "all-states")
    own = of.groupBy(*group, "key").agg(*_moment_sums())
    total = every.agg(*_moment_sums()).first()
    empty = own.select(*group, F.col("sk").alias("units"), F.col("sy").alias("y"), F.col("sn").alias("n"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _FIT.split(", "))])
    if total.sk is None:
        return empty
    centre = _whole(every, "one").first()  # one row
    at, sums0 = (centre.u, centre.v), np.array([centre[p] for p in L.PARTS])
    left = [F.lit(total[c]) - F.col(c) for c in ("sy", "sn", "sk", "sr", "sq")]
    mean, strength = windows.moments(*left)
    ok = left[2] >= 2
    params = own.where(ok).select("key", (F.col("sk") * EXACT_SHARE >= total.sk).alias("exact"), F.lit(at[0]).alias("u"), F.lit(at[1]).alias("v"), F.lit(1.0).alias("move"))
    params = kept(params, "fit")

    @F.pandas_udf(_STEP)
    def stepped(u: pd.Series, v: pd.Series, mine: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        a, b = u.to_numpy(np.float64), v.to_numpy(np.float64)
        g0, h0, t0 = L.slopes(sums0, np.array(at[0]), np.array(at[1]))
        g, h = L.moved(g0, h0, t0, a - at[0], b - at[1])
        known = outside["a1"].notna().to_numpy()
        if known.any():
            g[known], h[known], _ = L.slopes(outside.to_numpy(np.float64)[known], a[known], b[known])
        g1, h1, _ = L.slopes(mine.to_numpy(np.float64), a, b)
        new = L.step(a, b, g - g1, h - h1)
        return pd.DataFrame({"u": new[0], "v": new[1], "move": np.maximum(np.abs(new[0] - a), np.abs(new[1] - b))})

    for _ in range(ROUNDS):
        if not params.where(F.col("move") >= L.LEAST_MOVE).limit(1).count():
            break
        large = params.where("exact").select("key", "u", "v").collect()  # EXACT_SHARE rows at most
        outside = every.sparkSession.createDataFrame([], f"key string, {', '.join(f'o_{p} double' for p in L.PARTS)}")
        if large:
            outside = every.mapInPandas(_at_many([(r.key, r.u, r.v) for r in large]), f"key string, {_PARTS}").groupBy("key").agg(*[F.sum(p).alias(f"o_{p}") for p in L.PARTS])
        j = params.join(_sums(of, params, "key"), "key").join(outside, "key", "left")
        other = F.struct(*[F.col(f"o_{p}").alias(p) for p in L.PARTS])
        after = kept(j.withColumn("s", stepped("u", "v", F.struct(*L.PARTS), other)).select("key", "exact", "s.u", "s.v", "s.move"), "fit")
        dropped(params)
        params = after
    fell = F.col("move") >= L.LEAST_MOVE
    a, b = F.exp("u"), F.exp("v")
    held = (F.least("u", "v") <= L.LOW + 1e-5) | (F.greatest("u", "v") >= L.HIGH - 1e-5)
    fit = F.when(F.col("u").isNull(), None).when(fell, "moment").when(held, "boundary").otherwise("likelihood")
    out = own.join(params, "key", "left")
    return out.select(*group, F.col("sk").alias("units"), F.col("sy").alias("y"), F.col("sn").alias("n"), F.when(fell, mean).otherwise(a / (a + b)).alias("fit_mean"), F.when(fell, strength).otherwise(a + b).alias("fit_concentration"), fit.alias("fit"))


def _at_many(params: list[tuple[str, float, float]]):
    """Parts of all states of a batch, summed for each of a few parameters."""

    def run(frames):
        for pdf in frames:
            y, n, w = _numbers(pdf, "y", "n", "w")
            sums = L.Sums(y, n, w).at(np.array([p[1] for p in params]), np.array([p[2] for p in params]))
            yield pd.DataFrame(sums, columns=L.PARTS).assign(key=[p[0] for p in params])[["key", *L.PARTS]]

    return run

