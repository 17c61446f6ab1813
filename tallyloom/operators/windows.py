"""Row-order logic: adjusted p-values, fallback pools, runs, versions, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.scratch import kept

EULER = 0.5772156649015329  # fixed value: the limit of 1 + 1/2 + .. + 1/m - ln m


def harmonic(m: Column) -> Column:
    """1 + 1/2 + .. + 1/m: summed up to 10,000, beyond that by its expansion, whose error is below 1e-17."""
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(m, F.lit(10_000))), F.lit(0.0), lambda s, i: s + 1.0 / i)
    return F.when(m <= 10_000, summed).otherwise(F.log(m) + EULER + 1 / (2.0 * m) - 1 / (12.0 * m * m))


def _beside(rows: DataFrame, ranges: DataFrame, family: str) -> DataFrame:
    """Rows with the columns of their family and range; a null family is a family."""
    r = ranges.withColumnsRenamed({family: "__f", "__part": "__p"})
    return rows.join(r, F.col(family).eqNullSafe(F.col("__f")) & (F.col("__part") == F.col("__p"))).drop("__f", "__p")


def by_adjust(df: DataFrame, family: str, p: str, tie: str) -> DataFrame:
    """Adds rank and q: Benjamini-Yekutieli over each family, ties of p by `tie`; rows with a null p get nulls.

    Rows are dealt by ranges of (family, p, tie). Ranks and least q count within a range, and what lies before and after
    it in its family is added from one row for each family and range: no task holds a whole family. The rows are written
    once before they are dealt, and once dealt, in the shared folder; nothing stays in the session's cache.
    """
    df = kept(df, "tested")
    tested = df.where(F.col(p).isNotNull())
    dealt = kept(tested.repartitionByRange(family, p, tie).withColumn("__part", F.spark_partition_id()), "dealt")
    by, within = Window.partitionBy(family), Window.partitionBy(family, "__part")
    upto = by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(family, "__part").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__n").over(upto), F.lit(0)), "__m": F.sum("__n").over(by)})
    sizes = sizes.select(family, "__part", "__before", (F.col("__m") * harmonic(F.col("__m"))).alias("__scale"))
    numbered = _beside(dealt.withColumn("__k", F.row_number().over(within.orderBy(p, tie))), sizes, family)
    ranked = numbered.withColumn("rank", F.col("__before") + F.col("__k")).withColumn("__raw", F.col(p) * F.col("__scale") / F.col("rank"))
    after = by.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy(family, "__part").agg(F.min("__raw").alias("__least"))
    least = least.select(family, "__part", F.min("__least").over(after).alias("__after"))
    back = within.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    out = _beside(ranked.withColumn("__here", F.min("__raw").over(back)), least, family)
    out = out.withColumn("q", F.least(F.lit(1.0), "__here", "__after"))  # least passes over nulls
    rest = df.where(F.col(p).isNull()).withColumn("rank", F.lit(None).cast("long")).withColumn("q", F.lit(None).cast("double"))
    return out.select(*df.columns, "rank", "q").unionByName(rest.select(*df.columns, "rank", "q"))


def fallback_pool(df: DataFrame, levels: list[str], eligible: Column, least: int) -> DataFrame:
    """Adds pool (the first of levels, finest first, with `least` other eligible rows), peers and reason.

    Without such a level: pool null, peers those of the last level, a reason. Rows that are not eligible say so.
    """
    ok = eligible.cast("int")
    out = df
    for level in levels:  # counts by level, joined back: no task holds a level's rows
        out = out.join(df.groupBy(level).agg(F.sum(ok).alias(f"__n_{level}")), level, "left").withColumn(f"__n_{level}", F.coalesce(f"__n_{level}", F.lit(0)) - ok)
    pool, peers = F.lit(None).cast("string"), F.col(f"__n_{levels[-1]}")
    for level in reversed(levels):
        enough = F.col(f"__n_{level}") >= least
        pool, peers = F.when(enough, F.lit(level)).otherwise(pool), F.when(enough, F.col(f"__n_{level}")).otherwise(peers)
    out = out.withColumn("pool", F.when(eligible, pool)).withColumn("peers", peers)
    reason = F.when(~eligible, "not_eligible").when(F.col("pool").isNull(), f"fewer_than_{least}_eligible_peers")
    return out.withColumn("reason", reason).drop(*[f"__n_{x}" for x in levels])


def moments(y: Column, n: Column, k: Column, r: Column, rr: Column) -> tuple[Column, Column]:
    """(mean, concentration) by moments from sums over k rows: of y, n, the rates r = y / n and their squares.

    The mean is the smoothed pooled rate, the variance that of the rates around it, each row counting once.
    """
    mean = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (y + 0.5) / (n + 1)))
    var = F.when(k > 0, (rr - 2 * mean * r + mean * mean * k) / k)
    return mean, F.when(k > 0, F.least(F.lit(1e6), F.greatest(F.lit(1e-3), mean * (1 - mean) / F.greatest(var, F.lit(1e-9)) - 1)))


def moment_sums(y: str, n: str) -> list[Column]:
    """The sums of `moments`, as __y, __n, __k, __r, __rr."""
    r = F.col(y) / F.col(n)
    return [F.sum(y).alias("__y"), F.sum(n).alias("__n"), F.count("*").alias("__k"), F.sum(r).alias("__r"), F.sum(r * r).alias("__rr")]


def moment_fit(df: DataFrame, pool: list[str], y: str, n: str) -> DataFrame:
    """Adds fit_mean, fit_concentration and fit_peers of the others of each row's pool: the pool's sums less the row's own.

    pool: columns without nulls; none of them: all rows are one pool.
    """
    sums = df.groupBy(*pool).agg(*moment_sums(y, n))
    out = df.join(sums, pool) if pool else df.crossJoin(F.broadcast(sums))  # one row
    r, c = F.col(y) / F.col(n), F.col
    mean, concentration = moments(c("__y") - c(y), c("__n") - c(n), c("__k") - 1, c("__r") - r, c("__rr") - r * r)
    fitted = out.withColumns({"fit_mean": mean, "fit_concentration": concentration, "fit_peers": c("__k") - 1})
    return fitted.select(*df.columns, "fit_mean", "fit_concentration", "fit_peers")


def blocks(df: DataFrame, place: list[str], sequence: str, category: str) -> DataFrame:
    """Adds block: runs of consecutive sequence numbers with a category; a gap or a null category breaks them."""
    w = Window.partitionBy(*place).orderBy(sequence)
    gap = (F.col(sequence) - F.lag(sequence).over(w)) != 1
    cut = F.coalesce(gap | F.lag(category).over(w).isNull(), F.lit(True)).cast("int")
    rows = df.withColumn("block", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col(category).isNotNull())


def runs_moments(df: DataFrame, block: list[str], sequence: str, category: str, least: int = 6) -> DataFrame:
    """Runs of two categories in a block: n, runs, expected, variance, fewer (rows of the rarer one); blocks under `least` or not of two kinds left out."""
    w = Window.partitionBy(*block).orderBy(sequence)
    changed = df.withColumn("__c", F.coalesce(F.col(category) != F.lag(category).over(w), F.lit(False)).cast("int"))
    each = changed.groupBy(*block, category).agg(F.count("*").alias("__n"), F.sum("__c").alias("__c"))
    g = each.groupBy(*block).agg(F.sum("__n").alias("n"), (F.sum("__c") + 1).alias("runs"), F.count(category).alias("kinds"), F.min("__n").alias("__a"))
    out = g.where(f"kinds = 2 and n >= {least}").where(" and ".join(f"`{c}` is not null" for c in block))
    n, a = F.col("n").cast("double"), F.col("__a").cast("double")
    b = n - a
    expected = 1 + 2 * a * b / n
    variance = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    return out.select(*block, "n", "runs", expected.alias("expected"), variance.alias("variance"), F.col("__a").alias("fewer"))


def versions(df: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Snapshots kept when their content differs from the one before, numbered from 1 by key."""
    w = Window.partitionBy(key).orderBy(*order)
    new = ~F.col(content).eqNullSafe(F.lag(content).over(w)) | (F.row_number().over(w) == 1)
    kept = df.withColumn("__new", new).where("__new").drop("__new")
    return kept.withColumn("version", F.row_number().over(w))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_two(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """First and second by value (ties by name) and their margin."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), name)
    r = df.withColumn("__n", F.row_number().over(w)).where("__n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("__n") == n, F.col(c)))
    out = r.groupBy(*keys).agg(pick(1, name).alias("first"), pick(2, name).alias("second"), pick(1, value).alias("first_value"), pick(2, value).alias("second_value"))
    return out.withColumn("margin", F.col("first_value") - F.coalesce("second_value", F.lit(0)))


def nested_sets(tree: DataFrame, scope: list[str], id_: str, path: str) -> DataFrame:
    """Adds tree_left, tree_right in path order: k-th node of depth d with n below it: 2k - 1 - d, and 2n - 1 more.

    path: array of ids from the root, the node's own last. Nodes are numbered by ranges of (scope, path), so a scope may
    hold any number of them.
    """
    from tallyloom.operators import trees

    below = tree.select(*scope, F.explode(path).alias("__a"), F.lit(1).alias("__one")).groupBy(*scope, "__a").agg(F.sum("__one").alias("__size"))
    k = trees.numbered(tree, scope, [path], "__k").withColumn("__a", F.element_at(path, -1))
    left = 2 * F.col("__k") - 1 - (F.size(path) - 1)
    out = k.join(below, [*scope, "__a"])
    return out.select(*tree.columns, left.cast("long").alias("tree_left"), (left + 2 * F.col("__size") - 1).cast("long").alias("tree_right"))


def nested_sets_by_links(tree: DataFrame, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """id, tree_left, tree_right of a forest given by parent links, siblings and tops in the order of their ids.

    A node starts one after its parent, and two more for each node of the siblings before it: those steps are summed from the
    top down. Nothing is made that is as long as the tree is deep.
    """
    from tallyloom.operators import trees

    names, links = trees.links(tree, id_, parent)
    sized = links.join(trees.sizes(links), "node")
    upto = kept(trees.running(sized, ["up"], ["node"], F.col("size"), "__upto"), "siblings")
    left, _ = trees.summed(upto, 1 + 2 * (F.col("__upto") - F.col("size")))
    out = left.join(upto.select("node", "size"), "node").join(names, "node")
    return out.select("id", F.col("steps").alias("tree_left"), (F.col("steps") + 2 * F.col("size") - 1).alias("tree_right"))


def ranks(df: DataFrame, by: dict[str, Column], tie: str) -> DataFrame:
    """Adds one rank for each named order. For small results: each order sorts all rows."""
    for name, order in by.items():
        df = df.withColumn(name, F.row_number().over(Window.orderBy(order, tie)))
    return df
