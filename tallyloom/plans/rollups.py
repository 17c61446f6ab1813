"""Queries on rollups, geography and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import read, rollup, windows
from tallyloom.plans import base as b
from tallyloom.plans.base import H, query

LEVEL_SETS = "GROUPING SETS ((department, category), (department, municipality, category), (department, municipality, place, category), (department, municipality, place, unit, category))"
LEVEL_NAME = "CASE WHEN grouping(municipality) = 1 THEN 'department' WHEN grouping(place) = 1 THEN 'municipality' WHEN grouping(unit) = 1 THEN 'place' ELSE 'unit' END"


@query(f"""SELECT {LEVEL_NAME} AS level, concat_ws('/', department, municipality, place, unit) AS id, category, sum(votes)::BIGINT AS votes,
  round(sum(votes) / sum(sum(votes)) OVER (PARTITION BY {LEVEL_NAME}, concat_ws('/', department, municipality, place, unit)), 9) AS share
FROM facts GROUP BY {LEVEL_SETS}""")
def rollup_levels(spark, d):
    """A1: exact rollup of four levels with category shares."""
    r = b.dealt(spark, d, rollup.rollup_levels(b.facts(spark, d), H, ["category"], "votes"), "level", "id")
    return r.withColumn("share", F.round(F.col("votes") / F.expr("sum(votes) over (partition by level, id)"), 9))


@query("SELECT level, id, parent_id, CASE level WHEN 'department' THEN id ELSE regexp_extract(id, '[^/]+$') END AS code FROM geo")
def geography(spark, d):
    """A6."""
    return rollup.geography(b.units(spark, d), H)


STATE = "st AS (SELECT department, municipality, place, unit, CASE WHEN unit % 7 <> 0 THEN v END AS votes, CASE WHEN unit % 7 <> 0 THEN 'observed' ELSE 'unavailable' END AS s FROM (SELECT department, municipality, place, unit, sum(votes)::BIGINT AS v FROM facts GROUP BY ALL))"


@query(f"""WITH {STATE} SELECT department, municipality, count(DISTINCT unit) AS units, count(*) FILTER (WHERE s = 'observed') AS observed_units,
  CASE WHEN bool_and(s = 'observed') THEN sum(votes)::BIGINT END AS votes, CASE WHEN bool_and(s = 'observed') THEN 'observed' ELSE 'unavailable' END AS votes_status
FROM st GROUP BY department, municipality""")
def rollup_all_or_nothing(spark, d):
    """Semantics 4: a total exists only if every part does."""
    return rollup.stateful_rollup(b.stateful(spark, d), H, "municipality", b.VOTES, "unit")


@query(f"""WITH {STATE} SELECT CASE WHEN grouping(municipality) = 1 THEN 'department' WHEN grouping(place) = 1 THEN 'municipality' ELSE 'place' END AS level,
  concat_ws('/', department, municipality, place) AS id, count(*) AS units, bool_and(s = 'observed') AS complete, CASE WHEN bool_and(s = 'observed') THEN sum(votes)::BIGINT END AS votes
FROM st GROUP BY GROUPING SETS ((department), (department, municipality), (department, municipality, place))""")
def rollup_derived_levels(spark, d):
    """A2: three levels in one pass."""
    return rollup.derived_levels(b.stateful(spark, d), H, ["department", "municipality", "place"], b.VOTES)


@query(f"""WITH {STATE}, e AS (SELECT place, count(DISTINCT unit) AS expected_units FROM units GROUP BY place),
h AS (SELECT place, count(DISTINCT unit) AS n, bool_and(s = 'observed') AS ok, sum(votes)::BIGINT AS v FROM st GROUP BY place)
SELECT e.place, expected_units, coalesce(n, 0) AS units, CASE WHEN n = expected_units AND ok THEN v END AS votes,
  CASE WHEN n IS NULL OR n < expected_units THEN 'missing_units' WHEN NOT ok THEN 'unobserved_values' END AS reason FROM e LEFT JOIN h USING (place)""")
def rollup_complete_only(spark, d):
    """A4: totals of places whose expected units are complete."""
    return rollup.complete_only(b.stateful(spark, d), b.units(spark, d), ["place"], "unit", b.VOTES)


@query("""WITH m AS (SELECT municipality, unit, category, votes FROM facts), c AS (SELECT municipality, count(DISTINCT unit) AS n FROM m GROUP BY ALL),
f AS (SELECT municipality, category, count(*) AS have, sum(votes)::BIGINT AS v FROM m GROUP BY ALL)
SELECT municipality, n AS records, coalesce(string_agg(category || '=' || v, ';' ORDER BY category) FILTER (WHERE have = n), '') AS kept,
  coalesce(string_agg(category, ';' ORDER BY category) FILTER (WHERE have < n), '') AS lost FROM c JOIN f USING (municipality) GROUP BY municipality, n""")
def rollup_maps(spark, d):
    """A3: sums of metric maps; a field stays only if every record has it."""
    rec = b.facts(spark, d).groupBy("municipality", "unit").agg(F.map_from_entries(F.collect_list(F.struct("category", "votes"))).alias("values"), F.lit(None).cast("long").alias("registered"))
    r = rollup.map_rollup(rec, ["municipality"], "values", "registered")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return r.select("municipality", "records", text.alias("kept"), F.array_join("unavailable_fields", ";").alias("lost"))


@query("""WITH t AS (SELECT department::VARCHAR AS id, category, sum(votes)::BIGINT AS v FROM facts WHERE department = 2 AND category = 'RF' GROUP BY ALL)
SELECT 'rebuilt' AS side, 'department' AS level, id, category, v AS votes FROM t UNION ALL SELECT 'stored', 'department', id, category, v + 1 FROM t""")
def rollup_difference(spark, d):
    """A stored rollup with one wrong total against its rebuilding from facts."""
    f = b.facts(spark, d)
    wrong = (F.col("department") == 2) & (F.col("category") == "RF")
    stored = f.groupBy("department", "category").agg(F.sum("votes").alias("votes")).select(F.lit("department").alias("level"), F.col("department").cast("string").alias("id"), "category", (F.col("votes") + wrong.cast("long")).alias("votes"))
    return rollup.rollup_difference(rollup.rollup_levels(f, H, ["category"], "votes").where("level = 'department'"), stored).select("side", "level", "id", "category", "votes")


@query("SELECT year, count(*) AS rows, sum(votes)::BIGINT AS total, count(DISTINCT (department, municipality, place, unit)) AS tuples, count(*) - count(DISTINCT (unit, category)) AS duplicates FROM facts GROUP BY year")
def control_counts(spark, d):
    """Distinct tuples, control totals and duplicates by round."""
    f = b.facts(spark, d)
    g = f.groupBy("year").agg(F.countDistinct(F.struct("department", "municipality", "place", "unit")).alias("tuples"), (F.count("*") - F.countDistinct("unit", "category")).alias("duplicates"))
    frozen = f.groupBy("year").agg(F.count("*").alias("rows"), F.sum("votes").alias("total"))
    return rollup.control_totals(f, "year", "votes", frozen).where("ok").join(g, "year").select("year", "rows", "total", "tuples", "duplicates")


@query("""WITH bad AS (SELECT * FROM geo WHERE id <> '1'), o AS (SELECT id, level, parent_id, 'orphan' AS finding FROM bad WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM bad)),
w AS (SELECT c.id, c.level, c.parent_id, 'wrong_level' AS finding FROM bad c JOIN bad p ON c.parent_id = p.id WHERE (c.level = 'municipality' AND p.level <> 'department') OR (c.level = 'place' AND p.level <> 'municipality') OR (c.level = 'unit' AND p.level <> 'place'))
SELECT * FROM o UNION ALL SELECT * FROM w""")
def geography_findings(spark, d):
    """Orphans and wrong parent levels of a geography that lost a department."""
    g = b.geo(spark, d).where("id <> '1'")
    return rollup.orphans(g).withColumn("finding", F.lit("orphan")).unionByName(rollup.wrong_parent_level(g, H).select("id", "level", "parent_id", F.lit("wrong_level").alias("finding")))


@query("SELECT concat_ws('/', department, municipality, place, unit) AS unit, concat_ws('/', department, municipality, place) AS place, concat_ws('/', department, municipality) AS municipality, department::VARCHAR AS department FROM units")
def lineage(spark, d):
    """Every unit with its ancestors."""
    return rollup.lineage(b.geo(spark, d), list(H.levels))


@query("""WITH u AS (SELECT place, unit, place::VARCHAR || (unit % 1000)::VARCHAR AS id, (unit % 1000)::VARCHAR AS number, CASE WHEN unit % 11 = 0 THEN id || 'x' ELSE id END AS given FROM units), p AS (SELECT DISTINCT place FROM units WHERE place % 13 <> 0)
SELECT given AS id, CASE WHEN p.place IS NULL THEN 'unknown_place' ELSE 'id_mismatch' END AS finding FROM u LEFT JOIN p USING (place) WHERE p.place IS NULL OR given <> id""")
def unit_id_check(spark, d):
    """Ids are place and display number."""
    number = (F.col("unit") % 1000).cast("string")
    id_ = F.concat(F.col("place").cast("string"), number)
    u = b.units(spark, d).select(F.col("place").cast("string").alias("place_id"), number.alias("display_number"), F.when(F.col("unit") % 11 == 0, F.concat(id_, F.lit("x"))).otherwise(id_).alias("id"))
    p = b.units(spark, d).where("place % 13 <> 0").select(F.col("place").cast("string").alias("place_id")).distinct()
    return rollup.unit_id_findings(u, p)


@query("SELECT unit, concat_ws('/', department, municipality, place, unit) AS id, concat_ws('/', department, municipality, place) AS parent_id FROM units")
def unit_geography(spark, d):
    """J6."""
    u = b.units(spark, d)
    return rollup.unit_paths(u.select("place", "unit"), u.select("place", H.path("place").alias("path")).distinct(), "place", "unit")


@query("""WITH c AS (SELECT place, count(*) AS children, CASE WHEN bool_and(unit % 7 <> 0) THEN sum(v)::BIGINT END AS s FROM (SELECT place, unit, sum(votes) AS v FROM facts GROUP BY ALL) GROUP BY place),
p AS (SELECT place, sum(votes)::BIGINT + CASE WHEN place % 5 = 0 THEN 1 ELSE 0 END AS value FROM facts GROUP BY place)
SELECT place, children, 'votes' AS field, value, s AS children_sum, CASE WHEN s IS NULL THEN 'blocked' WHEN s = value THEN 'equal' ELSE 'different' END AS status FROM p JOIN c USING (place)""")
def place_sums(spark, d):
    """Place totals against their units, with blockers."""
    parents = b.facts(spark, d).groupBy("place").agg(F.sum("votes").alias("votes")).withColumn("votes", F.col("votes") + (F.col("place") % 5 == 0).cast("int"))
    return rollup.parent_sums(b.stateful(spark, d), parents, "place", ["votes"])


@query("SELECT sum(votes) FILTER (WHERE department <> 4)::BIGINT AS parts, sum(votes)::BIGINT AS whole, bool_and(department <> 4) AS equal FROM facts")
def national_total(spark, d):
    """One department is missing."""
    f = b.facts(spark, d)
    return rollup.total_check(f.where("department <> 4").groupBy("department").agg(F.sum("votes").alias("votes")), f, "votes")


@query("""SELECT municipality, count(*) AS n_categories, sha256(string_agg(category || '=' || v, ';' ORDER BY category, v)) AS digest, count(DISTINCT category) < count(*) AS repeated
FROM (SELECT municipality, category, sum(votes)::BIGINT AS v FROM facts GROUP BY ALL) GROUP BY municipality""")
def ordered_categories(spark, d):
    """Ordered category lists with digests."""
    g = b.facts(spark, d).groupBy("municipality", "category").agg(F.sum("votes").alias("votes"))
    return rollup.ordered_categories(g, ["municipality"], "category", "votes").drop("categories")


@query("""SELECT year, min(o_orderdate) AS first_date, count(DISTINCT place) AS places, count(*) AS units, max(CASE WHEN department = 0 THEN municipality END) AS marked FROM units GROUP BY year""")
def election_stats(spark, d):
    """A22."""
    return b.units(spark, d).groupBy("year").agg(F.min("o_orderdate").alias("first_date"), F.countDistinct("place").alias("places"), F.count("*").alias("units"), F.max(F.when(F.col("department") == 0, F.col("municipality"))).alias("marked"))


@query("""WITH k AS (SELECT category, dense_rank() OVER (ORDER BY category) AS category_id FROM (SELECT DISTINCT category FROM facts))
SELECT category_id, department, sum(votes)::BIGINT AS votes FROM facts JOIN k USING (category) GROUP BY ALL""")
def dictionary_rekey(spark, d):
    """Categories with dense ids, facts re-keyed."""
    _, f = rollup.rekeyed(b.facts(spark, d), "category", "category_id")
    return f.groupBy("category_id", "department").agg(F.sum("votes").alias("votes"))


@query("""WITH t AS (SELECT id, string_split(id, '/') AS p FROM geo WHERE level <> 'unit'), k AS (SELECT id, p, row_number() OVER (ORDER BY list_transform(p, lambda x: x::BIGINT)) AS k, len(p) - 1 AS dp FROM t),
s AS (SELECT a.id, count(*) AS n FROM t a JOIN t x ON x.id = a.id OR starts_with(x.id, a.id || '/') GROUP BY a.id)
SELECT id, 2 * k - 1 - dp AS tree_left, 2 * k - 1 - dp + 2 * n - 1 AS tree_right FROM k JOIN s USING (id)""")
def nested_sets(spark, d):
    """Nested-set bounds by windows."""
    t = b.geo(spark, d).where("level <> 'unit'").select("id", F.transform(F.split("id", "/"), lambda x: x.cast("long")).alias("nums"))
    ids = F.transform(F.sequence(F.lit(1), F.size("nums")), lambda n: F.array_join(F.slice(F.transform("nums", lambda v: F.lpad(v.cast("string"), 12, "0")), 1, n), "/"))
    return windows.nested_sets(t.select("id", ids.alias("path"), F.lit(1).alias("scope")), ["scope"], "id", "path").select("id", "tree_left", "tree_right")


@query("SELECT id, level FROM geo WHERE id = '2' OR starts_with(id, '2/')")
def subtree_path(spark, d):
    """F4."""
    return b.geo(spark, d).where(read.subtree("id", "2")).select("id", "level")


@query("SELECT id, len(string_split(id, '/')) - 1 AS depth FROM geo WHERE level <> 'unit' AND (id = '2' OR starts_with(id, '2/'))")
def subtree_recursive(spark, d):
    """the same by recursive descent."""
    return read.descend(b.geo(spark, d).where("level <> 'unit'"), "2")


@query("""WITH t AS (SELECT id, string_split(id, '/') AS p FROM geo WHERE level = 'place') SELECT id, i - 1 AS depth, array_to_string(p[1:i], '/') AS ancestor FROM t, unnest(range(1, len(p) + 1)) AS u(i)""")
def paths_from_root(spark, d):
    """ancestors of places by walking parent links."""
    return read.path_from_root(b.geo(spark, d).where("level <> 'unit'"), F.col("level") == "place")


def _chains(spark, d) -> DataFrame:
    """Orders as a forest of opaque ids: an order's parent is the customer's order before it, by key, but for every 40th."""
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("lag(o_orderkey) over (partition by o_custkey % 20 order by o_orderkey)").alias("p"))
    return o.select(F.md5(F.col("k").cast("string")).alias("id"), F.when(F.col("k") % 40 != 0, F.md5(F.col("p").cast("string"))).alias("parent_id"))


_CHAINS = "WITH RECURSIVE o AS (SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS p FROM orders), c AS (SELECT md5(k::VARCHAR) AS id, CASE WHEN k % 40 <> 0 THEN md5(p::VARCHAR) END AS parent_id FROM o)"


@query(f"{_CHAINS}, t AS (SELECT id, 0::BIGINT AS depth, id AS ancestor, parent_id AS up FROM c UNION ALL SELECT t.id, t.depth + 1, c.id, c.parent_id FROM t JOIN c ON t.up = c.id) SELECT id, max(depth) OVER (PARTITION BY id) - depth AS depth, ancestor FROM t")
def deep_paths(spark, d):
    """F24 on long chains of ids that are no paths."""
    return read.path_from_root(_chains(spark, d))


@query(f"{_CHAINS}, s AS (SELECT min(id) AS root FROM c WHERE parent_id IS NULL), t AS (SELECT c.id, 0::BIGINT AS depth FROM c JOIN s ON c.id = s.root UNION ALL SELECT c.id, t.depth + 1 FROM t JOIN c ON c.parent_id = t.id) SELECT id, depth FROM t")
def deep_subtree(spark, d):
    """F6 on the same: all below the first top."""
    t = _chains(spark, d)
    return read.descend(t, t.where("parent_id is null").agg(F.min("id")).first()[0])


@query(f"""{_CHAINS}, t AS (SELECT id, [id] AS path, parent_id AS up FROM c UNION ALL SELECT t.id, list_prepend(c.id, t.path), c.parent_id FROM t JOIN c ON t.up = c.id), p AS (SELECT id, path FROM t WHERE up IS NULL),
n AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(path) AS a FROM p) GROUP BY a), k AS (SELECT id, row_number() OVER (ORDER BY path) AS k, len(path) - 1 AS dp FROM p) SELECT id, 2 * k - 1 - dp AS tree_left, 2 * k - 1 - dp + 2 * n - 1 AS tree_right FROM k JOIN n USING (id)""")
def nested_sets_by_links(spark, d):
    """W12 from parent links."""
    return windows.nested_sets_by_links(_chains(spark, d))


@query("SELECT 'no_result' AS side, count(*) AS n FROM units WHERE unit % 13 = 0 UNION ALL SELECT 'no_geography', count(*) FROM units WHERE unit % 11 = 0")
def key_sets(spark, d):
    """Units of the geography without results, and results without geography, after both lost some."""
    u = b.units(spark, d).select(H.path("unit").alias("id"), "unit")
    g, f = b.geo(spark, d).where("level = 'unit'").select("id").join(u.where("unit % 11 = 0").select("id"), "id", "left_anti"), u.where("unit % 13 <> 0").select("id")
    lost = u.where("unit % 11 = 0 and unit % 13 = 0").select("id")  # in neither set
    one = g.subtract(f).withColumn("side", F.lit("no_result")).unionByName(f.subtract(g).withColumn("side", F.lit("no_geography")))
    both = lost.withColumn("side", F.explode(F.array(F.lit("no_result"), F.lit("no_geography"))))
    return one.unionByName(both).groupBy("side").agg(F.count("*").alias("n"))
