"""Statistical screens. Every input unit comes back, with eligibility and a reason; none is dropped."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import digest, likelihood, stats
from tallyloom.operators import fits, trees, windows
from tallyloom.scratch import kept

LEAST_DENOMINATOR, LEAST_PEERS, MOST_STATES = 80, 30, 512
SHRINK = 8.0  # n / (n + SHRINK) is the weight of a level's own fit


def eligibility(complete: Column, joined: Column, denominator: Column) -> tuple[Column, Column]:
    """(eligible, reason): a complete vector, a joined denominator, and one of at least 80."""
    reason = F.when(~F.coalesce(complete, F.lit(False)), "incomplete_vector").when(~F.coalesce(joined, F.lit(False)), "denominator_not_joined").when(F.coalesce(denominator, F.lit(0)) < LEAST_DENOMINATOR, "small_denominator")
    return reason.isNull(), reason


def family_gate(df: DataFrame, declared: DataFrame, family: str, unit: str) -> DataFrame:
    """One row for each family seen or declared: members, digest, family_reason (null if it is as declared).

    declared: family, members, digest (`digest.set_digest` of the units' `digest.tuple_hash`). A family that is not
    declared, or whose number of units or digest is another, is not screened at all.
    """
    seen = digest.set_digest(df.withColumn("__h", digest.tuple_hash(F.col(unit))), [family], "__h")
    want = declared.select(F.col(family).alias("__f"), F.col("members").alias("__m"), F.col("digest").alias("__d"), F.lit(True).alias("__declared"))
    j = seen.join(want, F.col(family).eqNullSafe(F.col("__f")), "full_outer")
    reason = (
        F.when(F.col("__declared").isNull(), "family_undeclared").when(F.col("members").isNull(), "family_missing")
        .when(F.col("members") != F.col("__m"), "family_count_differs").when(~F.col("digest").eqNullSafe(F.col("__d")), "family_digest_differs")
    )
    return j.select(F.coalesce(family, "__f").alias(family), "members", "digest", reason.alias("family_reason"))


def gated(df: DataFrame, declared: DataFrame, family: str, unit: str, eligible: str) -> DataFrame:
    """df with family_reason, and eligible false in families that are not as declared: what a peer screen takes."""
    gate = family_gate(df, declared, family, unit).select(F.col(family).alias("__f"), "family_reason")
    j = df.join(gate, F.col(family).eqNullSafe(F.col("__f"))).drop("__f")
    return j.withColumn(eligible, F.col(eligible) & F.col("family_reason").isNull())


def complete_families(screen, df: DataFrame, declared: DataFrame, family: str, unit: str, levels: list[str], y: str, n: str, eligible: str) -> DataFrame:
    """A peer screen (`peer_screen` or `peer_screen_moments`) of complete families; the units of others abstain with the
    family's reason."""
    out = screen(gated(df, declared, family, unit, eligible), family, unit, levels, y, n, eligible)
    return out.withColumn("reason", F.coalesce("family_reason", "reason")).drop("family_reason")


def _scored(df: DataFrame, y: str, n: str, mean: str, concentration: str) -> DataFrame:
    """Adds z, effect_points, p, low and high; a row with n = 0 (never eligible) has none of them.

    Rows with one state and fit are dealt to one task, side by side, so each tail is computed once a batch.
    """
    df = df.repartition(y, n, mean, concentration).sortWithinPartitions(y, n, mean, concentration)
    a, b = F.col(mean) * F.col(concentration), (1 - F.col(mean)) * F.col(concentration)
    z = F.try_divide(F.col(y) - F.col(n) * F.col(mean), F.sqrt(stats.beta_binomial_variance(F.col(n), a, b)))
    tail = stats.beta_binomial_tail(F.col(y).cast("double"), F.col(n).cast("double"), F.col(mean), F.col(concentration))
    return df.withColumn("__t", tail).select("*", z.alias("z"), (100 * (F.try_divide(F.col(y), F.col(n)) - F.col(mean))).alias("effect_points"), F.col("__t.p").alias("p"), F.col("__t.low").alias("low"), F.col("__t.high").alias("high")).drop("__t")


def peer_screen_moments(df: DataFrame, family: str, unit: str, levels: list[str], y: str, n: str, eligible: str) -> DataFrame:
    """Peer screen with leave-one-out moment fits from pools' sums: pool, peers, reason, fit, z, effect, p, rank, q.

    levels: finest first. Pools hold eligible rows only; a row without enough peers abstains.
    """
    keyed = kept(df.withColumns({f"__{x}": F.concat_ws("|", F.col(family).cast("string"), F.col(x).cast("string")) for x in levels}), "screened")
    pooled = windows.fallback_pool(keyed, [f"__{x}" for x in levels], F.col(eligible), LEAST_PEERS)
    pooled = pooled.withColumn("pool", F.substring("pool", 3, 99))
    fits = None
    for x in levels:  # each level's rows are fitted against all eligible rows of that level
        rows = windows.moment_fit(pooled.where(F.col(eligible)), [f"__{x}"], y, n).where(F.col("pool") == x)
        fits = rows if fits is None else fits.unionByName(rows)
    rest = pooled.where("pool is null").withColumns({"fit_mean": F.lit(None).cast("double"), "fit_concentration": F.lit(None).cast("double")})
    out = _scored(fits.drop("fit_peers").unionByName(rest).drop(*[f"__{x}" for x in levels]), y, n, "fit_mean", "fit_concentration")
    return windows.by_adjust(out, family, "p", unit).withColumn("signal", F.lit(False))


def _fit_states(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fits of one pool, each state left out once; over MOST_STATES one fit of the whole pool, labelled so.

    A fit at a bound of its parameters is replaced by the moment fit of the same rows.
    """
    y, n, w = (pdf[c].to_numpy(np.float64) for c in ("y", "n", "w"))
    if len(y) > MOST_STATES:
        out = [likelihood.whole_fit(y, n, w)]
        rest = [w]
    else:
        out = likelihood.left_out(y, n, w)
        rest = [w - (np.arange(len(w)) == i) if o[2] == "boundary" else w for i, o in enumerate(out)]
    out = [(*stats.moment_fit(y[v > 0], n[v > 0], v[v > 0]), "moment") if o[2] == "boundary" else o for o, v in zip(out, rest, strict=True)]
    if len(y) > MOST_STATES:
        out = [(out[0][0], out[0][1], f"{out[0][2]}_whole_pool")] * len(y)
    return pdf[["pool_key", "y", "n"]].assign(fit_mean=[o[0] for o in out], fit_concentration=[o[1] for o in out], fit=[o[2] for o in out])


def peer_screen(df: DataFrame, family: str, unit: str, levels: list[str], y: str, n: str, eligible: str) -> DataFrame:
    """Peer screen with leave-one-out maximum likelihood over the pool's distinct (y, n) states.

    Rows are pre-aggregated to states with counts, so a task holds a pool's states, not its rows.
    """
    keyed = kept(df.withColumns({f"__{x}": F.concat_ws("|", F.col(family).cast("string"), F.col(x).cast("string")) for x in levels}), "screened")
    pooled = windows.fallback_pool(keyed, [f"__{x}" for x in levels], F.col(eligible), LEAST_PEERS).withColumn("pool", F.substring("pool", 3, 99))
    key = F.coalesce(*[F.when(F.col("pool") == x, F.concat(F.lit(f"{x}|"), f"__{x}")) for x in levels])
    k = pooled.withColumn("pool_key", key)
    # states of every level in one aggregation, then only those of pools that serve some unit
    every = keyed.where(F.col(eligible)).select(F.explode(F.array(*[F.concat(F.lit(f"{x}|"), f"__{x}") for x in levels])).alias("pool_key"), F.col(y).cast("long").alias("y"), F.col(n).cast("long").alias("n"))
    states = every.groupBy("pool_key", "y", "n").agg(F.count("*").alias("w")).join(k.select("pool_key").distinct(), "pool_key", "left_semi")
    fits = states.groupBy("pool_key").applyInPandas(_fit_states, "pool_key string, y long, n long, fit_mean double, fit_concentration double, fit string")
    f = fits.withColumnRenamed("y", "__y").withColumnRenamed("n", "__n")
    out = k.join(f, (k.pool_key == f.pool_key) & (k[y].cast("long") == f["__y"]) & (k[n].cast("long") == f["__n"]), "left").drop(f.pool_key).drop("__y", "__n", "pool_key", *[f"__{x}" for x in levels])
    return windows.by_adjust(_scored(out, y, n, "fit_mean", "fit_concentration"), family, "p", unit).withColumn("signal", F.lit(False))


def research_endpoint(screen: DataFrame, special: Column) -> DataFrame:
    """Rows of a likelihood fit with 200 peers, p <= .001, q <= .05, |z| >= 3.5 and 8 points (3 for special metrics)."""
    return screen.where((F.col("fit") == "likelihood") & (F.col("peers") >= 200) & (F.col("p") <= 0.001) & (F.col("q") <= 0.05) & (F.abs("z") >= 3.5) & (F.abs("effect_points") >= F.when(special, 3.0).otherwise(8.0)))


def place_totals(df: DataFrame, keys: list[str], y: str, n: str, complete: str) -> DataFrame:
    """Totals of whole places, refused with a reason when one of their units is incomplete."""
    g = df.groupBy(*keys).agg(F.count("*").alias("units"), F.bool_and(complete).alias("__ok"), F.sum(y).alias("__y"), F.sum(n).alias("__n"))
    ok = F.col("__ok")
    return g.select(*keys, "units", F.when(ok, F.col("__y")).alias(y), F.when(ok, F.col("__n")).alias(n), F.when(~ok, "incomplete_unit").alias("refused"))


def cluster_screen(df: DataFrame, family: str, place: str, levels: list[str], y: str, n: str, complete: str, moments: bool = False) -> DataFrame:
    """Screen of whole places among places of their municipality, else department and size band, else department."""
    from tallyloom.functions.text import size_band

    fine, coarse = levels
    p = place_totals(df, [family, *levels[::-1], place], y, n, complete)
    p = p.withColumn("size_band", size_band(F.col("units"))).withColumn("banded", F.concat_ws("|", F.col(coarse).cast("string"), "size_band"))
    ok, reason = eligibility(F.col("refused").isNull(), F.lit(True), F.col(n))
    p = p.withColumn("eligible", ok).withColumn("refused", F.coalesce("refused", reason))
    screen = peer_screen_moments if moments else peer_screen
    out = screen(p, family, place, [fine, "banded", coarse], y, n, "eligible").drop("banded")
    fit = F.lit("moment") if moments else F.col("fit")
    return out.withColumn("signal", F.coalesce((fit == "likelihood") & (F.col("q") <= 0.05), F.lit(False)))


def _fitted_by_moments(df: DataFrame, levels: list[str], y: str, n: str) -> DataFrame:
    """Rows with m_i, mean_i, strength_i of all others (i = 0) and of the others of each level (1, 2, ..)."""
    pools = [[], *[levels[: i + 1] for i in range(len(levels))]]
    sums = df.groupBy(*levels).agg(*windows.moment_sums(y, n))  # the finest pools; the others are sums of these
    names, out = [c for c in sums.columns if c.startswith("__")], df
    for i, pool in enumerate(pools):
        up = sums.groupBy(*pool).agg(*[F.sum(c).alias(f"{c}_{i}") for c in names])
        out = out.join(up, pool) if pool else out.crossJoin(F.broadcast(up))  # one row
    r = F.col(y) / F.col(n)
    for i in range(len(pools)):
        less = [F.col(f"{c}_{i}") - own for c, own in zip(names, (F.col(y), F.col(n), F.lit(1), r, r * r), strict=True)]
        mean, strength = windows.moments(*less)
        out = out.withColumns({f"m_{i}": less[2], f"mean_{i}": mean, f"strength_{i}": strength, f"fit_{i}": F.lit("moment")})
    return out.select(*df.columns, *[f"{c}_{i}" for i in range(len(pools)) for c in ("m", "mean", "strength", "fit")])


def _fitted_by_likelihood(df: DataFrame, levels: list[str], y: str, n: str, most_states: int) -> DataFrame:
    """The same by maximum likelihood. Fits are joined to distinct states, and those once to the rows."""
    name = lambda i: F.concat_ws("|", F.lit(str(i)), *[F.col(c).cast("string") for c in levels[:i]])
    pools = [name(i) for i in range(len(levels) + 1)]
    found = kept(fits.left_out(fits.states(df, pools, y, n), most_states), "left-out-fits")
    distinct = df.select(*levels, F.col(y).cast("long").alias("__y"), F.col(n).cast("long").alias("__n")).distinct()
    for i, pool in enumerate(pools):
        f = found.select("pool_key", F.col("y").alias("__fy"), F.col("n").alias("__fn"), F.col("fit_peers").alias(f"m_{i}"), F.col("fit_mean").alias(f"mean_{i}"), F.col("fit_concentration").alias(f"strength_{i}"), F.col("fit").alias(f"fit_{i}"))
        distinct = distinct.withColumn("__k", pool).join(f, (F.col("__k") == F.col("pool_key")) & (F.col("__y") == F.col("__fy")) & (F.col("__n") == F.col("__fn"))).drop("__k", "pool_key", "__fy", "__fn")
    keyed = df.withColumns({"__y": F.col(y).cast("long"), "__n": F.col(n).cast("long")})
    return keyed.join(distinct, [*levels, "__y", "__n"]).drop("__y", "__n")


def hierarchical_reference(df: DataFrame, levels: list[str], y: str, n: str, eligible: str, fit: str = "likelihood", most_states: int = fits.MOST_STATES) -> DataFrame:
    """Leave-one-out reference of each row, fitted to unit rows and shrunk down the levels (coarsest first).

    Adds ref_level, ref_mean, ref_concentration, ref_fit, variance, p (two-sided tail) and low, high (central 95 %, as
    rates). All rows, then each level, are fitted without the row, by maximum likelihood (a fit that does not settle falls
    back to moments; fit = "moment" takes those throughout). A level's fit of m others, two at least, gets weight m / (m + 8)
    against its parent's: means linearly, concentrations geometrically. The level named is the finest with enough others: 9
    in the place, 1 in the municipality, else the department, which must have 30. ref_fit: likelihood if all levels used
    settled inside their bounds, else not_converged; moment. Levels must not be null in eligible rows.
    """
    df = kept(df, "screened")
    some = df.where(F.col(eligible))
    fitted = _fitted_by_moments(some, levels, y, n) if fit == "moment" else _fitted_by_likelihood(some, levels, y, n, most_states)
    mean, strength, sound, level = F.col("mean_0"), F.col("strength_0"), F.col("fit_0") == "likelihood", F.lit(None).cast("string")
    for i, x in enumerate(levels, 1):
        m = F.col(f"m_{i}")
        w, usable = m / (m + SHRINK), m >= 2
        mean = F.when(usable, w * F.col(f"mean_{i}") + (1 - w) * mean).otherwise(mean)
        strength = F.when(usable, F.exp(w * F.log(f"strength_{i}") + (1 - w) * F.log(strength))).otherwise(strength)
        sound = F.when(usable, sound & (F.col(f"fit_{i}") == "likelihood")).otherwise(sound)
        enough = m >= (0 if i == 1 else 1 if i < len(levels) else 9)
        last = (mean, strength, sound) if i == 1 else tuple(F.when(enough, a).otherwise(b) for a, b in zip((mean, strength, sound), last, strict=True))
        level = F.when(enough, F.lit(x)).otherwise(level)
    ok = F.col("m_1") >= LEAST_PEERS
    said = F.lit("moment") if fit == "moment" else F.when(last[2], "likelihood").otherwise("not_converged")
    kinds = {"ref_level": "string", "ref_mean": "double", "ref_concentration": "double", "ref_fit": "string"}
    new = dict(zip(kinds, (level, last[0], last[1], said), strict=True))
    out = fitted.withColumns({c: F.when(ok, v) for c, v in new.items()}).select(*df.columns, *kinds)
    rest = df.where(~F.coalesce(F.col(eligible), F.lit(False)))
    out = out.unionByName(rest.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()}))
    a, b = F.col("ref_mean") * F.col("ref_concentration"), (1 - F.col("ref_mean")) * F.col("ref_concentration")
    tail = stats.beta_binomial_tail(F.col(y).cast("double"), F.col(n).cast("double"), F.col("ref_mean"), F.col("ref_concentration"))
    out = out.withColumn("variance", stats.beta_binomial_variance(F.col(n), a, b)).withColumn("__t", tail)
    return out.select("*", F.col("__t.p").alias("p"), (F.col("__t.low") / F.col(n)).alias("low"), (F.col("__t.high") / F.col(n)).alias("high")).drop("__t")


def municipality_left_out(df: DataFrame, department: str, municipality: str, y: str, n: str, fit: str = "likelihood") -> DataFrame:
    """Each municipality's total against the unit rows of all other municipalities, fitted by likelihood or by moments.

    expected and variance with one latent rate shared by the municipality; null with fewer than two rows outside. No
    p-value: the uncertainty of the fit is not in the variance. fit: how the others were fitted.
    """
    group = [department, municipality]
    if fit == "likelihood":
        out = fits.groups_left_out(df, group, y, n).withColumnsRenamed({"fit_mean": "mean", "fit_concentration": "concentration"})
    else:
        own = df.groupBy(*group).agg(*windows.moment_sums(y, n))
        sums = ("__y", "__n", "__k", "__r", "__rr")
        total = own.agg(*[F.sum(c).alias(f"{c}_all") for c in sums])  # one row
        every = own.crossJoin(F.broadcast(total))
        mean, concentration = windows.moments(*[F.col(f"{c}_all") - F.col(c) for c in sums])
        ok = F.col("__k_all") - F.col("__k") >= 2
        out = every.select(*group, F.col("__k").alias("units"), F.col("__y").alias("y"), F.col("__n").alias("n"), F.when(ok, mean).alias("mean"), F.when(ok, concentration).alias("concentration"), F.when(ok, "moment").alias("fit"))
    a, b = F.col("mean") * F.col("concentration"), (1 - F.col("mean")) * F.col("concentration")
    return out.select(*group, "units", "y", "n", (F.col("n") * F.col("mean")).alias("expected"), stats.beta_binomial_variance(F.col("n"), a, b).alias("variance"), "fit")


# Screens by permutation: draws depend on the municipality's key, its data and the batch, never on the partitioning.


def _seed(group, start: int, *data: np.ndarray) -> np.random.Generator:
    seed = hashlib.sha256(str(group).encode())
    for x in data:
        seed.update(np.ascontiguousarray(x).tobytes())
    return np.random.default_rng([int.from_bytes(seed.digest()[:8], "little"), start])


def _batched(df: DataFrame, first: int, last: int, batch: int) -> DataFrame:
    """df once for each batch of the permutations first .. last - 1, with the batch's start and size."""
    starts = df.withColumn("start", F.explode(F.sequence(F.lit(first), F.lit(last - 1), F.lit(batch))))
    return starts.withColumn("size", F.least(F.lit(batch), F.lit(last) - F.col("start")))


def _reached(tops: np.ndarray):
    """Column function: how many of the permutations' maxima reach a value."""
    ordered = np.sort(tops)

    def count(value: pd.Series) -> pd.Series:
        return pd.Series(len(ordered) - np.searchsorted(ordered, value.abs().to_numpy(np.float64) - 1e-12)).where(value.notna().to_numpy()).astype("Int64")

    return F.pandas_udf(count, "long")


def runs_distribution(a: int, b: int) -> np.ndarray:
    """Probabilities of 2, 3, .. a + b runs when a and b labels of two kinds are shuffled."""
    k = np.arange(1, a + b)
    with np.errstate(divide="ignore", invalid="ignore"):
        choose = lambda n, m: np.where((m >= 0) & (m <= n), np.exp(stats.log_gamma(np.full(len(m), n + 1.0)) - stats.log_gamma(np.maximum(m, 0) + 1.0) - stats.log_gamma(np.maximum(n - m, 0) + 1.0) - total), 0.0)
        total = 0.5 * float((stats.log_gamma(np.array([a + b + 1.0])) - stats.log_gamma(np.array([a + 1.0])) - stats.log_gamma(np.array([b + 1.0])))[0])
        even = 2 * choose(a - 1, k - 1) * choose(b - 1, k - 1)
        odd = choose(a - 1, k) * choose(b - 1, k - 1) + choose(a - 1, k - 1) * choose(b - 1, k)
    out = np.zeros(a + b - 1)
    for runs, p in ((2 * k, even), (2 * k + 1, odd)):
        inside = runs <= a + b
        out[runs[inside] - 2] = p[inside]
    return out / out.sum()


@lru_cache(maxsize=4096)
def _runs_steps(a: int, b: int) -> np.ndarray:
    """Where the distribution of runs steps up; kept by the worker, since every batch and municipality has the same few."""
    return np.cumsum(runs_distribution(a, b))[:-1]


def _drawn_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """|z| of one municipality for each permutation of a batch: runs of a shuffled block are drawn from their distribution."""
    start, size = int(pdf["start"].iloc[0]), int(pdf["size"].iloc[0])
    pdf = pdf.sort_values(["place", "block"], kind="stable").reset_index(drop=True)
    rng = _seed(pdf["municipality"].iloc[0], start, *(pdf[c].to_numpy(np.float64) for c in ("a", "b", "expected", "variance")))
    drawn = np.empty((len(pdf), size), np.int32)
    for (a, b), rows in sorted(pdf.groupby(["a", "b"]).indices.items()):
        drawn[rows] = np.searchsorted(_runs_steps(int(a), int(b)), rng.random((len(rows), size))) + 2
    first = np.flatnonzero(np.concatenate([[True], pdf["place"].to_numpy()[1:] != pdf["place"].to_numpy()[:-1]]))
    e, v = (np.add.reduceat(pdf[c].to_numpy(np.float64), first)[:, None] for c in ("expected", "variance"))
    z = ((np.add.reduceat(drawn, first, axis=0) - e) / np.sqrt(v)).sum(0) / np.sqrt(len(first))
    return pd.DataFrame({"permutation": start + np.arange(size), "top": np.abs(z)})


def runs_screen(df: DataFrame, place: str, municipality: str, sequence: str, category: str, permutations: int = 9_999, batch: int = 256) -> DataFrame:
    """Municipalities' runs z (sum of place z over root k) with max-T p-values over the family of municipalities.

    Blocks have 6 values and two categories at least. A permutation shuffles each block; only its number of runs matters,
    so that is drawn from its exact distribution. (municipality, batch of permutations) is the unit of work; one maximum
    for each permutation reaches the driver. 999 permutations at least.
    """
    if permutations < 999:
        raise ValueError("at least 999 permutations")
    b = windows.blocks(df, [municipality, place], sequence, category)
    found = kept(windows.runs_moments(b, [municipality, place, "block"], sequence, category).where("variance > 0"), "runs")
    places = found.groupBy(municipality, place).agg(F.sum("runs").alias("runs"), F.sum("expected").alias("e"), F.sum("variance").alias("v"))
    observed = places.groupBy(municipality).agg((F.sum((F.col("runs") - F.col("e")) / F.sqrt("v")) / F.sqrt(F.count("*"))).alias("z"), F.count("*").alias("places"))
    rows = found.select(F.col(municipality).alias("municipality"), F.col(place).alias("place"), "block", F.col("fewer").cast("int").alias("a"), (F.col("n") - F.col("fewer")).cast("int").alias("b"), "expected", "variance")
    drawn = _batched(rows, 0, permutations, batch).groupBy("municipality", "start").applyInPandas(_drawn_runs, "permutation long, top double")
    tops = drawn.groupBy("permutation").agg(F.max("top").alias("top")).toPandas()["top"].to_numpy(np.float64)
    return observed.select(municipality, "places", "z", ((1 + _reached(tops)("z")) / (permutations + 1)).alias("p"))


DEEPEST = 10  # halvings of the widest cell: at 20 km, down to some 20 m


def _cells(level: Column, lat: Column, lon: Column, most_km: float, rows: list[int]) -> list[tuple[Column, Column]]:
    """(row, column) of a place in the grid of a level, for its own row of cells and others beside it.

    Cells are as high as the level's reach and, by their row's farthest edge from the equator, at least as wide, with 1 %
    to spare: who is within reach stands in one of three rows and, in that row's own grid, three columns.
    """
    high = F.lit(most_km / 110.0) / F.pow(F.lit(2.0), level)
    out = []
    for r in rows:
        row = F.floor(lat / high).cast("long") + r
        least = F.least(*[F.cos(F.radians((row + e) * high)) for e in (-1, 0, 1, 2)])
        out.append((row, F.floor(lon / (F.lit(1.01) * high / F.greatest(least, F.lit(0.02)))).cast("long")))
    return out


def neighbours(units: DataFrame, unit: str, group: str, lat: str, lon: str, k: int = 5, most_km: float = 20.0) -> DataFrame:
    """The k nearest units of the same group within most_km, ties by id: unit, other, km, n.

    Units at one place are one place with its k + 1 least ids. A place searches the grid whose cells are twice as wide as
    the finest cell around it that holds k others: those are nearer than the grid's reach, so nearer ones cannot be outside
    the nine cells around it. Where there is no such cell the widest grid, of the whole reach, is searched. So a
    crowded cell is split as far as it is crowded, and never makes all its pairs. Longitudes do not wrap at 180 degrees.
    """
    base = units.select(F.col(unit).alias("u"), F.col(group).alias("g"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo")).where("u is not null and g is not null and la is not null and lo is not null")
    place, first = ["g", "la", "lo"], Window.partitionBy("g", "la", "lo", "salt").orderBy("u")
    few = base.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(64))).withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1)
    few = few.withColumn("i", F.row_number().over(Window.partitionBy(*place).orderBy("u"))).where(F.col("i") <= k + 1)
    places = kept(few.groupBy(*place).agg(F.array_sort(F.collect_list("u")).alias("ids")), "places")  # k + 1 ids at most
    level = F.col("level")
    (row, column), *_ = _cells(level, F.col("la"), F.col("lo"), most_km, [0])
    every = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST)))).withColumns({"row": row, "column": column})
    full = every.groupBy("g", "level", "row", "column").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > k)
    finest = every.join(full, ["g", "level", "row", "column"]).groupBy(*place).agg(F.max("level").alias("finest"))
    reach = F.when(F.abs("la") > 80, 0).otherwise(F.greatest(F.coalesce(F.col("finest") - 1, F.lit(0)), F.lit(0)))
    here = places.drop("ids").join(finest, place, "left").select(*place, reach.alias("level"))
    beside = _cells(level, F.col("la"), F.col("lo"), most_km, [-1, 0, 1])
    around = F.array(*[F.struct(r.alias("row"), (c + e).alias("column")) for r, c in beside for e in (-1, 0, 1)])
    here = here.withColumn("cell", F.explode(around)).select(*place, "level", "cell.row", "cell.column")
    # few bytes and much to compute: dealt into all of the session's tasks, not into as few as the bytes need
    here = here.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "level", "row", "column")
    there = every.select("g", "level", "row", "column", F.col("la").alias("la2"), F.col("lo").alias("lo2"), "ids")
    km = stats.haversine_km(F.col("la"), F.col("lo"), F.col("la2"), F.col("lo2"))
    found = here.join(there, ["g", "level", "row", "column"]).withColumn("km", km).where(F.col("km") <= most_km).select(*place, "km", F.explode("ids").alias("other"))
    nearest = found.withColumn("i", F.row_number().over(Window.partitionBy(*place).orderBy("km", "other"))).where(F.col("i") <= k + 1)
    nearest = nearest.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("km", "other"))).alias("near"))
    mine = base.join(nearest, place).select("u", F.posexplode(F.slice(F.filter("near", lambda x: x["other"] != F.col("u")), 1, k)).alias("n", "x"))
    return mine.select(F.col("u").alias(unit), F.col("x.other").alias("other"), F.col("x.km").alias("km"), (F.col("n") + 1).alias("n"))


def local_moran(units: DataFrame, links: DataFrame, unit: str, group: str, residual: str, least: int = 3) -> DataFrame:
    """I = z * mean of the neighbours' z / variance, z centred by group; units with under `least` neighbours get null."""
    of = units.groupBy(group).agg(F.avg(residual).alias("__mean"), F.var_pop(residual).alias("v"))
    z = units.join(of, group).withColumn("z", F.col(residual) - F.col("__mean"))
    lag = links.join(z.select(F.col(unit).alias("other"), F.col("z").alias("zo")), "other").groupBy(unit).agg(F.avg("zo").alias("lag"), F.count("*").alias("neighbours"))
    out = z.join(lag, unit, "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    moran = F.when((F.col("neighbours") >= least) & (F.col("v") > 0), F.col("z") * F.col("lag") / F.col("v"))
    return out.select(*units.columns, "neighbours", moran.alias("local_i"))


def spatial_units(rows: DataFrame, unit: str, group: str, lat: str, lon: str, residual: str, accuracy: str, cross_border: str) -> DataFrame:
    """Units from rows with a status: ok, invalid, inconsistent (several coordinates) or colocated; residuals are means."""
    valid = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.coalesce(F.col(cross_border), F.lit(False)) & (F.coalesce(F.col(accuracy), F.lit(1e9)) <= 500)
    g = rows.withColumn("__v", valid).groupBy(unit).agg(
        F.min(group).alias(group), F.bool_and("__v").alias("__ok"), F.countDistinct(lat, lon).alias("__c"), F.min(lat).alias(lat), F.min(lon).alias(lon),
        F.avg(F.when(F.col("__v"), F.col(residual))).alias(residual), F.count("*").alias("rows"),
    )
    fine = F.col("__ok") & (F.col("__c") == 1)
    together = F.sum(fine.cast("int")).over(Window.partitionBy(group, lat, lon))
    status = F.when(~F.col("__ok"), "invalid").when(F.col("__c") > 1, "inconsistent").when(together > 1, "colocated").otherwise("ok")
    return g.withColumn("status", status).drop("__ok", "__c")


MOST_ACCURACY_M = 500
EXCLUSIONS = ("invalid_row", "inconsistent_unit", "colocated_units", "not_the_place's_representative", "fewer_than_3_neighbours", "fewer_than_100_eligible_units")


def located_units(rows: DataFrame, row: str, place: str, grain: str, group: str, lat: str, lon: str, residual: str, accuracy: str, cross_border: str) -> tuple[DataFrame, DataFrame]:
    """(units, rows): the units of a spatial screen, and every row with its unit and the reason why it is out, if it is.

    A row located by its polling place (grain "place") belongs to the place's unit, another is a unit of its own. A row
    without coordinates, across a border or located worse than to 500 m is invalid. A unit's valid rows must agree
    on group, coordinates and grain; units of a group must not share coordinates; of a place's rows the least id represents
    it. units: unit, group, lat, lon, residual (mean of the valid rows), rows.
    """
    valid = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.coalesce(F.col(cross_border), F.lit(False)) & (F.coalesce(F.col(accuracy), F.lit(0)) <= MOST_ACCURACY_M)
    by_place = F.coalesce(F.col(grain) == "place", F.lit(False))
    unit = F.when(by_place, F.concat(F.lit("place:"), F.col(place).cast("string"))).otherwise(F.concat(F.lit("row:"), F.col(row).cast("string")))
    r = rows.withColumns({"unit": unit, "__valid": valid, "__by_place": by_place})
    where = F.struct(F.col(group), F.col(lat), F.col(lon), F.col(grain))
    g = r.where("__valid").groupBy("unit").agg(
        F.min(group).alias(group), (F.min(where) == F.max(where)).alias("__one"), F.min(lat).alias(lat), F.min(lon).alias(lon), F.avg(residual).alias(residual), F.count("*").alias("rows"), F.min(row).alias("__first"),
    )
    g = kept(g, "units")
    together = g.where("__one").groupBy(group, lat, lon).count().where("count > 1").drop("count").withColumn("__with", F.lit(True))
    g = g.join(together, [group, lat, lon], "left").withColumn("__with", F.coalesce("__with", F.lit(False)) & F.col("__one"))
    state = r.join(g.select("unit", "__one", "__with", "__first"), "unit", "left")
    reason = F.when(~F.col("__valid"), EXCLUSIONS[0]).when(~F.col("__one"), EXCLUSIONS[1]).when(F.col("__with"), EXCLUSIONS[2]).when(F.col("__by_place") & (F.col(row) != F.col("__first")), EXCLUSIONS[3])
    return g.where("__one and not __with").select("unit", group, lat, lon, residual, "rows"), state.select(*rows.columns, "unit", reason.alias("reason"))


def spatial_observed(rows: DataFrame, row: str, place: str, grain: str, group: str, lat: str, lon: str, residual: str, accuracy: str, cross_border: str, least_units: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `spatial_signals` knows before it permutes: (rows with unit, neighbours, local_i and reason; units; work).

    Reasons are given in the order of EXCLUSIONS; a unit with neighbours whose group does not vary has local_i null.
    """
    units, said = located_units(rows, row, place, grain, group, lat, lon, residual, accuracy, cross_border)
    seen, work = _moran_work(units, "unit", group, lat, lon, residual, least_units)
    seen = kept(seen, "observed")
    late = F.when(F.col("neighbours") < 3, EXCLUSIONS[4]).when(F.col("local_i").isNull(), "no_variance").when(~F.col("tested"), EXCLUSIONS[5])
    found = seen.select("unit", "neighbours", "local_i", late.alias("__late"))
    j = said.join(found, "unit", "left")
    shown = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return j.select(*rows.columns, "unit", shown("neighbours"), shown("local_i"), F.coalesce("reason", "__late").alias("reason")), seen, work


def spatial_signals(rows: DataFrame, row: str, place: str, grain: str, group: str, lat: str, lon: str, residual: str, accuracy: str, cross_border: str, permutations: int = 9_999, most: int = 99_999, batch: int = 256, least_units: int = 100) -> DataFrame:
    """Spatial screen of raw rows: units, exclusions, neighbours, local Moran, max-T permutations, rank. All rows come back.

    Adds unit, neighbours, local_i, p, rank, flag, kind and reason. A place's result stands once, at its representative.
    """
    _enough(permutations)
    shown, seen, work = spatial_observed(rows, row, place, grain, group, lat, lon, residual, accuracy, cross_border, least_units)
    tested = _permuted(seen, work, "unit", permutations, most, batch).select("unit", "p", "rank", "flag", "kind")
    j = shown.join(tested, "unit", "left")
    here = F.col("reason").isNull()
    return j.select(*shown.columns[:-1], F.when(here, F.col("p")).alias("p"), F.when(here, F.col("rank")).alias("rank"), F.coalesce(here & F.col("flag"), F.lit(False)).alias("flag"), F.when(here, F.col("kind")).alias("kind"), "reason")


MOST_EXTENDED = 99_999  # permutations where a p-value of the first ones is 0.01 or less
COLUMNS = 64  # tested units whose statistics of a batch are computed at once
DRAWN = 1 << 22  # values of a municipality that are drawn at once: 32 MB, a permutation at least
TASK = 8  # batches of permutations that are computed one after the other
LEAST_DRAWN = 1 << 23  # values that a task draws, as far as more tasks than the session's are made


def _moran_parts(pdf: pd.DataFrame) -> tuple:
    """One municipality: units, residuals, places of the tested, places of their neighbours (the place after the last: none), how many."""
    pdf = pdf.sort_values("unit", kind="stable").reset_index(drop=True)
    at = pd.Series(np.arange(len(pdf)), index=pdf["unit"])
    tested = np.flatnonzero(pdf["tested"].to_numpy(bool))
    count = pdf["others"].str.len().to_numpy()[tested].astype(np.int64)
    names = np.concatenate([np.asarray(o) for o in pdf["others"].iloc[tested]]) if len(tested) else np.zeros(0)
    index = np.full((len(tested), count.max(initial=1)), len(pdf))
    index[np.arange(index.shape[1]) < count[:, None]] = at.reindex(names).to_numpy()
    return pdf["unit"].to_numpy(), pdf["residual"].to_numpy(np.float64), tested, index, count


def _moran_draws(parts: tuple, group, start: int, size: int):
    """One batch of a municipality: (units, permutations, |observed|, |statistics| by unit and permutation) in chunks.

    units and permutations are slices of the tested ones and of the batch. Permutations are drawn one after the other, so
    many at once as DRAWN values hold. A unit's values in them lie side by side, so a neighbour's are read as one run of
    memory; a chunk stays in the processor's cache. Tables are whole runs of memory whatever the number of permutations:
    of a part of a wider one, each read would copy all. What is given out is overwritten by the next chunk.
    """
    _, x, tested, index, count = parts
    z, v = x - x.mean(), x.var()
    width = max(1, min(size, DRAWN // len(z)))
    columns = COLUMNS * max(1, 256 // width)
    rng, drawn = _seed(group, start, x), np.zeros((len(z) + 1) * width)
    whole, scale = np.append(z, 0.0), 1 / np.maximum(count * v, np.finfo(float).tiny)
    sums, buffer = np.empty((2, min(columns, len(tested)) * width))
    rows = np.tile(z, (width, 1))
    for at in range(0, size, width):
        n = min(width, size - at)
        rows[:n] = z
        for row in rows[:n]:
            rng.shuffle(row)  # what permuted() draws, in less time
        values = drawn[: (len(z) + 1) * n].reshape(-1, n)
        values[:-1], values[-1] = rows[:n].T, 0.0
        for c in range(0, len(tested), columns):
            own, near, by = tested[c : c + columns], index[c : c + columns], scale[c : c + columns]
            lag, one = (a[: len(own) * n].reshape(-1, n) for a in (sums, buffer))
            np.take(values, near[:, 0], axis=0, out=lag, mode="clip")
            for j in range(1, near.shape[1]):
                lag += np.take(values, near[:, j], axis=0, out=one, mode="clip")
            lag *= np.take(values, own, axis=0, out=one, mode="clip")
            lag *= by[:, None]
            yield slice(c, c + len(own)), slice(at, at + n), np.abs(z[own] * whole[near].sum(1) * by), np.abs(lag, out=lag)


def _top_moran(pdf: pd.DataFrame) -> pd.DataFrame:
    """One municipality, some batches of permutations: the largest statistic of each. Draws depend on the batch alone."""
    start, size, batch = (int(pdf[c].iloc[0]) for c in ("start", "size", "batch"))
    parts, tops = _moran_parts(pdf), []
    for at in range(start, start + size, batch):
        tops.append(np.zeros(min(batch, start + size - at)))
        for _, some, _, drawn in _moran_draws(parts, pdf["group"].iloc[0], at, len(tops[-1])):
            np.maximum(tops[-1][some], drawn.max(0), out=tops[-1][some])
    return pd.DataFrame({"permutation": np.arange(start, start + size), "top": np.concatenate(tops)})


def _unit_moran(pdf: pd.DataFrame) -> pd.DataFrame:
    """One municipality, some batches: how many of each unit's statistics reach what was observed."""
    start, size, batch = (int(pdf[c].iloc[0]) for c in ("start", "size", "batch"))
    parts = _moran_parts(pdf)
    reached = np.zeros(len(parts[2]), np.int64)
    for at in range(start, start + size, batch):
        for units, _, observed, drawn in _moran_draws(parts, pdf["group"].iloc[0], at, min(batch, start + size - at)):
            reached[units] += (drawn >= observed[:, None] - 1e-12).sum(1)
    return pd.DataFrame({"unit": parts[0][parts[2]], "reached": reached})


def _moran_work(units: DataFrame, unit: str, group: str, lat: str, lon: str, residual: str, least_units: int) -> tuple[DataFrame, DataFrame]:
    """(rows with neighbours, local_i and tested; all units of municipalities with tested ones, with their neighbours).

    The units that tasks permute are numbers in the order of (group, unit); id is the unit.
    """
    units = kept(units, "units")
    links = kept(neighbours(units, unit, group, lat, lon), "neighbours")
    moran = local_moran(units, links, unit, group, residual)
    counts = moran.groupBy(group).agg(F.count("local_i").alias("__scored"))
    rows = moran.join(counts, group).withColumn("tested", F.col("local_i").isNotNull() & (F.col("__scored") >= least_units))
    work = rows.where(F.col("__scored") >= least_units).select(F.col(group).alias("group"), F.col(unit).alias("id"), F.col(residual).alias("residual"), "tested", F.lit(1).alias("__all"))
    work = kept(trees.numbered(work, ["__all"], ["group", "id"], "unit").drop("__all"), "numbers")
    to = links.select(F.col(unit).alias("id"), "other").join(work.select(F.col("id").alias("other"), F.col("unit").alias("__to")), "other")
    near = to.groupBy("id").agg(F.array_sort(F.collect_list("__to")).alias("others"))  # k at most
    work = work.join(near, "id", "left").withColumn("others", F.coalesce("others", F.array().cast(near.schema["others"].dataType)))
    return rows.drop("__scored"), kept(work.select("group", "unit", "residual", "others", "tested", "id"), "work")


def _enough(permutations: int) -> None:
    if permutations < 9_999:
        raise ValueError("at least 9,999 permutations")


def _dealt(work: DataFrame, first: int, last: int, batch: int, units: int, groups: int) -> DataFrame:
    """work once for each TASK batches. (municipality, TASK batches) are dealt into twice as many tasks, so that few share one.

    They are few bytes and much to compute: Spark's own size rules would put them into a few tasks. units, groups: of work, or more.
    """
    rows = _batched(work.drop("id"), first, last, TASK * batch).withColumn("batch", F.lit(batch))
    tasks = min(2 * groups * -(-(last - first) // (TASK * batch)), units * (last - first) // LEAST_DRAWN)
    return rows.repartition(tasks, "group", "start") if tasks > int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _permuted(rows: DataFrame, work: DataFrame, unit: str, permutations: int, most: int, batch: int) -> DataFrame:
    """p, rank, flag and kind of tested units by synchronised max-T permutations; nulls for the others."""
    size = work.agg(F.count("*"), F.countDistinct("group")).first()

    def tops(first: int, last: int) -> np.ndarray:
        found = _dealt(work, first, last, batch, *size).groupBy("group", "start").applyInPandas(_top_moran, "permutation long, top double")
        return found.groupBy("permutation").agg(F.max("top").alias("top")).toPandas()["top"].to_numpy(np.float64)

    got, largest = tops(0, permutations), rows.where("tested").agg(F.max(F.abs("local_i")).alias("m")).first().m
    if largest is not None and most > permutations and (1 + (got >= largest - 1e-12).sum()) / (1 + permutations) <= 0.01:
        got, permutations = np.concatenate([got, tops(permutations, most)]), most
    out = rows.withColumn("p", F.when(F.col("tested"), (1 + _reached(got)("local_i")) / (1 + permutations)))
    flag = F.coalesce((F.col("p") <= 0.001) & (F.abs("local_i") >= 0.25), F.lit(False))
    ranked = kept(out.where("tested").select(unit, "p"), "tested")
    ranked = trees.numbered(ranked.withColumn("__all", F.lit(1)), ["__all"], ["p", unit], "rank").select(unit, "rank")
    return out.join(ranked, unit, "left").withColumns({"flag": flag, "kind": F.when(flag, F.when(F.col("local_i") > 0, "cluster").otherwise("outlier"))})


def spatial_screen(units: DataFrame, unit: str, group: str, lat: str, lon: str, residual: str, permutations: int = 9_999, most: int = MOST_EXTENDED, batch: int = 256, least_units: int = 100) -> DataFrame:
    """Local Moran screen with synchronised max-T permutations: neighbours, local_i, p, rank, flag, kind, reason.

    All valid units of a municipality are exchanged; those with 3 neighbours in a municipality of least_units such
    units are tested. A task holds one municipality and one batch of permutations; one maximum for each permutation
    reaches the driver. p = (1 + reached) / (1 + N); if one is 0.01 or less, N grows to `most` for all. rank: by p, then unit.
    """
    _enough(permutations)
    rows, work = _moran_work(units, unit, group, lat, lon, residual, least_units)
    rows = kept(rows, "observed")
    out = _permuted(rows, work, unit, permutations, most, batch)
    reason = F.when(F.col("neighbours") < 3, "fewer_than_3_neighbours").when(F.col("local_i").isNull(), "no_variance").when(~F.col("tested"), f"fewer_than_{least_units}_eligible_units")
    return out.select(*units.columns, "neighbours", "local_i", "p", "rank", "flag", "kind", reason.alias("reason"))


def joint_permutations(units: DataFrame, unit: str, group: str, lat: str, lon: str, residual: str, permutations: int = 9_999, most: int = MOST_EXTENDED, batch: int = 256, least_units: int = 100) -> DataFrame:
    """Each tested unit's own permutation p inside its municipality: unit, local_i, permutations, p.

    One shuffle of a municipality's residuals serves all its units. Municipalities in which a p is 0.01 or less are
    extended to `most` permutations.
    """
    _enough(permutations)
    rows, work = _moran_work(units, unit, group, lat, lon, residual, least_units)
    size = work.agg(F.count("*"), F.countDistinct("group")).first()

    def reached(some: DataFrame, first: int, last: int) -> DataFrame:
        found = _dealt(some, first, last, batch, *size).groupBy("group", "start").applyInPandas(_unit_moran, "unit long, reached long")
        return found.groupBy("unit").agg(F.sum("reached").alias("reached")).join(work.select("unit", F.col("id").alias("__id")), "unit").select(F.col("__id").alias(unit), "reached")

    tested = rows.where("tested").select(unit, group, "local_i")
    first = kept(tested.join(reached(work, 0, permutations), unit), "reached")
    low = first.where((1 + F.col("reached")) / (1 + permutations) <= 0.01).select(group).distinct().withColumn("__more", F.lit(True))
    more = reached(work.join(low.select(F.col(group).alias("group")), "group", "left_semi"), permutations, most).withColumnRenamed("reached", "__again")
    out = first.join(low, group, "left").join(more, unit, "left")
    n = F.when(F.col("__more"), F.lit(most)).otherwise(F.lit(permutations)).cast("long")
    return out.select(unit, "local_i", n.alias("permutations"), ((1 + F.col("reached") + F.coalesce("__again", F.lit(0))) / (1 + n)).alias("p"))
