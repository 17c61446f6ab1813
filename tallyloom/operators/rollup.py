"""Exact rollups of counts up a hierarchy, geography tables and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import trees
from tallyloom.schema import Hierarchy, Metric


def rollup_levels(facts: DataFrame, h: Hierarchy, keys: list[str], value: str) -> DataFrame:
    """One row for each level, place of that level and keys: level, id (path), keys, total of value.

    Grouping sets expand map-side and aggregate partially before the one shuffle.
    """
    sets = [[F.col(c) for c in h.key(level)] + [F.col(k) for k in keys] for level in h.levels]
    cols = [*h.levels, *keys]
    out = facts.groupingSets(sets, *cols).agg(F.sum(value).alias(value), F.grouping_id().alias("__gid"))
    n, k = len(h.levels), len(keys)
    level = F.element_at(F.array(*[F.lit(x) for x in h.levels]), n - F.bit_count(F.shiftright("__gid", k)).cast("int"))
    return out.select(level.alias("level"), F.concat_ws("/", *[F.col(c).cast("string") for c in h.levels]).alias("id"), *keys, value)


def geography(facts: DataFrame, h: Hierarchy) -> DataFrame:
    """Distinct places of every level: level, id (path), parent_id (null at the top), code."""
    places = [F.struct(F.lit(x).alias("level"), h.path(x).alias("id"), (h.path(h.levels[i - 1]) if i else F.lit(None).cast("string")).alias("parent_id"), F.col(x).cast("string").alias("code")) for i, x in enumerate(h.levels)]
    # distinct at the finest level first, so the explode works on places and not on facts
    return facts.select(*h.levels).distinct().select(F.explode(F.array(*places)).alias("p")).select("p.*").distinct()


def stateful_rollup(facts: DataFrame, h: Hierarchy, level: str, metric: Metric, unit: str) -> DataFrame:
    """Sums at one level that exist only if every unit is observed: value, its status, units, observed units."""
    seen = F.count_if(metric.observed())
    out = facts.groupBy(*h.key(level)).agg(F.countDistinct(unit).alias("units"), seen.alias("observed_units"), F.count("*").alias("rows"), F.sum(metric.value).alias("__sum"))
    whole = F.col("observed_units") == F.col("rows")
    return out.select(*h.key(level), "units", "observed_units", F.when(whole, F.col("__sum")).alias(metric.value), F.when(whole, "observed").otherwise("unavailable").alias(metric.status))


def derived_levels(facts: DataFrame, h: Hierarchy, levels: list[str], metric: Metric) -> DataFrame:
    """Several derived levels in one pass of grouping sets, with an all-observed flag."""
    cols = h.levels[: max(h.levels.index(x) for x in levels) + 1]
    out = facts.groupingSets([[F.col(c) for c in h.key(x)] for x in levels], *cols).agg(
        F.bool_and(metric.observed()).alias("complete"), F.sum(metric.value).alias("__sum"), F.count("*").alias("units"), F.grouping_id().alias("__gid")
    )
    level = F.element_at(F.array(*[F.lit(x) for x in cols]), len(cols) - F.bit_count("__gid").cast("int"))
    return out.select(level.alias("level"), F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("id"), "units", "complete", F.when(F.col("complete"), F.col("__sum")).alias(metric.value))


def complete_only(facts: DataFrame, expected: DataFrame, keys: list[str], unit: str, metric: Metric) -> DataFrame:
    """Totals of groups whose expected units are all there, once each, and observed; others abstain with a reason."""
    want = expected.groupBy(*keys).agg(F.countDistinct(unit).alias("expected_units"))
    known = facts.join(expected.select(*keys, unit).distinct(), [*keys, unit], "left_semi")
    have = known.groupBy(*keys).agg(F.countDistinct(unit).alias("units"), F.count("*").alias("rows"), F.count_if(metric.observed()).alias("seen"), F.sum(metric.value).alias("__sum"))
    reason = (
        F.when(F.col("units").isNull() | (F.col("units") < F.col("expected_units")), "missing_units")
        .when(F.col("rows") > F.col("units"), "duplicated_units")
        .when(F.col("seen") < F.col("rows"), "unobserved_values")
    )
    return want.join(have, keys, "left").select(*keys, "expected_units", F.coalesce("units", F.lit(0)).alias("units"), F.when(reason.isNull(), F.col("__sum")).alias(metric.value), reason.alias("reason"))


def map_rollup(records: DataFrame, keys: list[str], values: str, registered: str) -> DataFrame:
    """Sums of the entries of a map column; a field is kept only if every record has it, registered only if complete."""
    n = records.groupBy(*keys).agg(F.count("*").alias("records"), F.count(registered).alias("__r"), F.sum(registered).alias("__reg"))
    fields = records.select(*keys, F.explode(values).alias("field", "value")).groupBy(*keys, "field").agg(F.count("value").alias("have"), F.sum("value").alias("value"))
    joined = fields.join(n, keys)
    kept = joined.where("have = records").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("kept"))  # fields are few
    lost = joined.where("have < records").groupBy(*keys).agg(F.array_sort(F.collect_list("field")).alias("unavailable"))
    out = n.join(kept, keys, "left").join(lost, keys, "left")
    reg = F.when(F.col("__r") == F.col("records"), F.col("__reg"))
    return out.select(*keys, "records", reg.alias(registered), F.map_from_entries(F.coalesce("kept", F.array().cast("array<struct<field:string,value:bigint>>"))).alias(values), F.coalesce("unavailable", F.array().cast("array<string>")).alias("unavailable_fields"))


def exact_rollup(facts: DataFrame, h: Hierarchy, unit: str, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(totals of every level, findings): rows with a duplicated unit and keys are reported and left out of the totals."""
    n = F.count("*").over(Window.partitionBy(unit, *keys))
    marked = facts.withColumn("__n", n)
    findings = marked.where("__n > 1").select(unit, *keys).distinct().withColumn("finding", F.lit("duplicate_identity"))
    return rollup_levels(marked.where("__n = 1").drop("__n"), h, keys, value), findings


def rollup_difference(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """Symmetric multiset difference: rows of one side that the other lacks, with the side."""
    stored = stored.select(*rebuilt.columns)
    return rebuilt.exceptAll(stored).withColumn("side", F.lit("rebuilt")).unionAll(stored.exceptAll(rebuilt).withColumn("side", F.lit("stored")))


def orphans(geo: DataFrame) -> DataFrame:
    """Places whose parent is not a place."""
    ids = geo.select(F.col("id").alias("parent_id")).distinct()
    return geo.where("parent_id is not null").join(ids, "parent_id", "left_anti").select("id", "level", "parent_id")


def wrong_parent_level(geo: DataFrame, h: Hierarchy) -> DataFrame:
    """Places whose parent's level is not the next coarser one."""
    above = F.create_map(*[F.lit(x) for pair in zip(h.levels[1:], h.levels[:-1], strict=True) for x in pair])
    parent = geo.select(F.col("id").alias("parent_id"), F.col("level").alias("parent_level"))
    return geo.join(parent, "parent_id").where(~F.col("parent_level").eqNullSafe(above[F.col("level")])).select("id", "level", "parent_id", "parent_level")


def control_totals(facts: DataFrame, by: str, value: str, controls: DataFrame) -> DataFrame:
    """Rows and totals by key against frozen (by, rows, total): what differs or is missing on a side, with both."""
    have = facts.groupBy(by).agg(F.count("*").alias("rows"), F.sum(value).alias("total"))
    want = controls.select(by, F.col("rows").alias("want_rows"), F.col("total").alias("want_total"))
    out = have.join(want, by, "full_outer")
    return out.withColumn("ok", F.col("rows").eqNullSafe(F.col("want_rows")) & F.col("total").eqNullSafe(F.col("want_total")))


def unit_paths(units: DataFrame, places: DataFrame, place: str, unit: str) -> DataFrame:
    """Unit geographies made from units and their places' paths (place, path): path/unit, parent path."""
    return units.join(places.select(place, F.col("path").alias("parent_id")), place).select(unit, F.concat_ws("/", "parent_id", F.col(unit).cast("string")).alias("id"), "parent_id")


def unit_id_findings(units: DataFrame, places: DataFrame) -> DataFrame:
    """Units (id, place_id, display_number) whose id is not place id + number, or whose place is unknown."""
    joined = units.join(places.select("place_id", F.lit(True).alias("known")), "place_id", "left")
    finding = F.when(F.col("known").isNull(), "unknown_place").when(F.col("id") != F.concat("place_id", "display_number"), "id_mismatch")
    return joined.select("id", finding.alias("finding")).where("finding is not null")


def lineage(geo: DataFrame, levels: list[str]) -> DataFrame:
    """One row for each place of the last level with the id of every ancestor, by chained equi joins; breaks give nulls."""
    at = geo.where(F.col("level") == levels[-1]).select(F.col("id").alias(levels[-1]), F.col("parent_id").alias("__up"))
    for level in reversed(levels[:-1]):
        up = geo.where(F.col("level") == level).select(F.col("id").alias(level), F.col("id").alias("__up"), F.col("parent_id").alias("__next"))
        at = at.join(up, "__up", "left").drop("__up").withColumnRenamed("__next", "__up")
    return at.drop("__up").select(*levels)


def parent_sums(children: DataFrame, parents: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Parents whose values are not the sums of their children's, by field; a null child value blocks its field."""
    agg = [F.when(F.count("*") == F.count(v), F.sum(v)).alias(f"sum_{v}") for v in values]
    sums = children.groupBy(key).agg(*agg, F.count("*").alias("children"))
    each = F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("bigint").alias("value"), F.col(f"sum_{v}").cast("bigint").alias("children_sum")) for v in values])
    out = parents.join(sums, key, "left").select(key, F.coalesce("children", F.lit(0)).alias("children"), F.explode(each).alias("f")).select(key, "children", "f.*")
    status = F.when(F.col("children") == 0, "no_children").when(F.col("children_sum").isNull(), "blocked").when(F.col("value").eqNullSafe(F.col("children_sum")), "equal").otherwise("different")
    return out.withColumn("status", status)


def total_check(parts: DataFrame, whole: DataFrame, value: str) -> DataFrame:
    """One row: the sum of the parts against a one-row whole."""
    return parts.agg(F.sum(value).alias("parts")).crossJoin(F.broadcast(whole.agg(F.sum(value).alias("whole")))).withColumn("equal", F.col("parts") == F.col("whole"))


def ordered_categories(facts: DataFrame, keys: list[str], category: str, value: str) -> DataFrame:
    """Ordered (category, value) list of each group with its count, digest, and whether a category is repeated."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(category).alias("category"), F.col(value).alias("value"))))
    out = facts.groupBy(*keys).agg(pairs.alias("categories"))
    text = F.array_join(F.transform("categories", lambda c: F.concat_ws("=", c["category"], c["value"].cast("string"))), ";")
    names = F.transform("categories", lambda c: c["category"])
    return out.select(*keys, "categories", F.size("categories").alias("n_categories"), F.sha2(text, 256).alias("digest"), (F.size(F.array_distinct(names)) < F.size("categories")).alias("repeated"))


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with dense ids in their order, numbered in ranges so that no task holds all keys."""
    keys = df.select(key).distinct()
    return trees.numbered(keys.withColumn("__all", F.lit(1)), ["__all"], [key], name).drop("__all")


def rekeyed(facts: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary of key, facts with the dictionary's ids instead)."""
    ids = dense_ids(facts, key, name)
    return ids, facts.join(ids, key).drop(key)


def summary_check(summary: DataFrame, parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A declared summary against the sum of its parts: keys, declared, computed, equal; a side that is missing differs."""
    c = parts.groupBy(*keys).agg(F.sum(value).alias("computed"))
    j = summary.select(*keys, F.col(value).alias("declared")).join(c, keys, "full_outer")
    return j.select(*keys, "declared", "computed", F.coalesce(F.col("declared") == F.col("computed"), F.lit(False)).alias("equal"))


def release_statistics(geo: DataFrame, counts: DataFrame, scope: list[str], first: list[str], top: str) -> DataFrame:
    """One row for each scope: least of the `first` columns, places, sum of their category counts, id of the top level.

    geo: scope, id, level and the `first` columns; counts: scope, id, category_count. Places without counts are left out.
    """
    j = geo.join(counts, [*scope, "id"])
    return j.groupBy(*scope).agg(*[F.min(c).alias(f"first_{c}") for c in first], F.count("*").alias("places"), F.sum("category_count").alias("categories"), F.max(F.when(F.col("level") == top, F.col("id"))).alias("top_id"))


def reported_rollup(facts: DataFrame, geo: DataFrame, levels: list[str], level: str, value: Metric, category: str) -> tuple[DataFrame, DataFrame]:
    """Totals of what was reported, places of `level` found by walking parents from the units of the last level.

    facts: id of a unit, category, value and its state, one row for each category. Returns (id, units_reported, units: all
    of the geography, value) and (id, category, value); unobserved values add nothing, units without a way up are left out.
    """
    walk = lineage(geo, levels).select(F.col(levels[-1]).alias("id"), F.col(level).alias("__up")).where("__up is not null")
    seen = F.sum(F.when(value.observed(), F.col(value.value)))
    per = facts.groupBy("id", category).agg(seen.alias("__v")).join(walk, "id").groupBy("__up", category).agg(F.sum("__v").alias("__v"))
    of = facts.select("id").distinct().withColumn("__r", F.lit(1))
    units = walk.join(of, "id", "left").groupBy("__up").agg(F.count("__r").alias("units_reported"), F.count("*").alias("units"))
    total = per.groupBy("__up").agg(F.coalesce(F.sum("__v"), F.lit(0)).alias(value.value))
    whole = units.join(total, "__up", "left").select(F.col("__up").alias("id"), "units_reported", "units", value.value)
    return whole, per.where("__v is not null").select(F.col("__up").alias("id"), category, F.col("__v").alias(value.value))
