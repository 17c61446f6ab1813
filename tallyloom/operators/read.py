"""Filtered, paged and nested reads of facts, places and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import trees


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of the filters that are given; None asks for nothing."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def with_member(df: DataFrame, array: str, field: str, value) -> DataFrame:
    """Rows whose array of structs has a member with field = value."""
    return df.where(F.exists(array, lambda c: c[field] == value))


def narrowed(df: DataFrame, array: str, field: str, value) -> DataFrame:
    """Arrays cut down to the members with field = value."""
    return df.withColumn(array, F.filter(array, lambda c: c[field] == value))


def subtree(path: str, root: str) -> Column:
    """Path is root's or below it; a slash ends each id, so ids that begin alike are not confused."""
    return (F.col(path) == root) | F.col(path).startswith(root + "/")


def subtree_bounds(df: DataFrame, left: int, right: int) -> DataFrame:
    """Places inside nested-set bounds."""
    return df.where(F.col("tree_left").between(left, right) & (F.col("tree_right") <= right))


def descend(geo: DataFrame, root: str) -> DataFrame:
    """A place and all below it by parent links, whatever the depth: id, depth."""
    return trees.descend(geo, root)


def page(df: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """Rows after a key tuple, in key order, one more than size so that a caller sees whether others follow."""
    if after is not None:
        df = df.where(F.col(keys[0]) >= after[0])  # reaches the scan; the tuple does not
        df = df.where(F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after, strict=True)]))
    return df.orderBy(*keys).limit(size + 1)


def having(df: DataFrame, details: DataFrame, key: list[str], condition: Column) -> DataFrame:
    """Rows that have a detail row of this kind."""
    return df.join(details.where(condition).select(*key), key, "left_semi")


def star(facts: DataFrame, sources: DataFrame, geo: DataFrame, source: str, place: str) -> DataFrame:
    """Facts with their source's and place's columns; unmatched facts go."""
    return facts.join(sources, source).join(geo, place)


def children(geo: DataFrame, facts: DataFrame, parent: str, category: str, value: str) -> DataFrame:
    """Children of a place with totals and ordered categories; a child without facts keeps its row.

    Only the children's facts are aggregated: they are picked out by a semi-join before.
    """
    own = geo.where(F.col("parent_id") == parent).select("id", "level")
    g = facts.join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.sum(value).alias("total"), F.array_sort(F.collect_list(F.struct(F.col(category).alias("category"), F.col(value).alias("value")))).alias("categories"))
    return own.join(g, "id", "left").withColumn("has_facts", F.col("total").isNotNull())


def path_from_root(geo: DataFrame, of: Column | None = None) -> DataFrame:
    """One row for each place (of those asked for) and ancestor, walked by parent links: id, depth (0: the root), ancestor."""
    return trees.paths(geo, of=of)


def unit_detail(units: DataFrame, lineage: DataFrame, facts: DataFrame, unit: str, source: str, value: str) -> DataFrame:
    """Units with their ancestors and one struct for each source."""
    by = facts.groupBy(unit, source).agg(F.sum(value).alias(value)).groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(source, value))).alias("sources"))
    return units.join(lineage, unit, "left").join(by, unit, "left")


def category_page(categories: DataFrame, sources: DataFrame, source: str, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """A page of categories with their source's provenance."""
    return page(categories.join(sources, source), keys, after, size)


def signals(df: DataFrame, kind: str | None, ancestor: str | None, ancestors: str = "ancestors") -> DataFrame:
    """Review signals by type and by any ancestor place."""
    df = filtered(df, signal_type=kind)
    return df.where(F.array_contains(ancestors, ancestor)) if ancestor is not None else df


def by_level(df: DataFrame, level: str, order: list[str], id_: str) -> DataFrame:
    """Ordered by the rank of the level, then id."""
    return df.orderBy(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(level)), id_)


def long_metrics(facts: DataFrame, id_: list[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide facts as long rows of rate metrics: name -> (numerator column, denominator column)."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(a).cast("bigint").alias("numerator"), F.col(b).cast("bigint").alias("denominator")) for m, (a, b) in metrics.items()]
    return facts.select(*id_, F.explode(F.array(*rows)).alias("m")).select(*id_, "m.*")


def family_rows(long: DataFrame, unit: str, target: str, others: list[str]) -> DataFrame:
    """The target metric's row of each unit with the other metrics of the same unit beside it, or a reason for leaving it out.

    long: unit, metric, numerator, denominator. One aggregation by unit, no self join.
    """
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    g = long.groupBy(unit).agg(*[pick(m, c).alias(f"{m}_{c}") for m in [target, *others] for c in ("numerator", "denominator")], *[F.count_if(F.col("metric") == m).alias(f"__{m}") for m in [target, *others]])
    reason = F.when(F.col(f"__{target}") == 0, "no_target").when(F.col(f"__{target}") > 1, "repeated_target")
    for m in others:
        reason = reason.when(F.col(f"__{m}") == 0, f"no_{m}")
    return g.withColumn("excluded", reason).drop(*[f"__{m}" for m in [target, *others]])


def bound_units(units: DataFrame, places: DataFrame, unit_code: str, place_code: str, width: int) -> DataFrame:
    """Units with the selected place whose code their own begins with; others get a finding. Joined on the beginning."""
    p = places.select(F.col(place_code).alias("__p"), F.lit(True).alias("__known")).distinct()
    j = units.withColumn("__p", F.substring(unit_code, 1, width)).join(p, "__p", "left")
    return j.withColumn("place", F.when(F.col("__known"), F.col("__p"))).withColumn("finding", F.when(F.col("__known").isNull(), "unknown_place")).drop("__p", "__known")


def cohort_registry(rows: DataFrame, family: str, pool: str, peers: str) -> DataFrame:
    """How often each pool served a family, with the least and most peers."""
    return rows.groupBy(family, pool).agg(F.count("*").alias("units"), F.min(peers).alias("least_peers"), F.max(peers).alias("most_peers"))


def anomaly_components(anomalies: DataFrame, id_: str, kind: str, component: str) -> DataFrame:
    """Anomalies with their components in order, most of them first."""
    return anomalies.groupBy(id_, kind).agg(F.array_sort(F.collect_set(component)).alias("components")).orderBy(F.desc(F.size("components")), id_)


def by_priority(df: DataFrame, score: str, id_: str) -> DataFrame:
    """Highest score first, then id."""
    return df.orderBy(F.desc(score), id_)


def unit_records(kinds: dict[str, DataFrame], unit: str, value) -> DataFrame:
    """All records of one unit: kind of record and the rest of its row as JSON, columns by name."""
    one = lambda k, df: df.where(F.col(unit) == value).select(F.lit(k).alias("record"), F.to_json(F.struct(*sorted(c for c in df.columns if c != unit)), {"ignoreNullFields": "false"}).alias("detail"))
    return reduce(DataFrame.unionByName, [one(k, df) for k, df in kinds.items()])
