"""Queries on scalar rules, nested documents, families and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import stats, text
from tallyloom.operators import crosswalk, quality, read, reconcile, rollup, screens, windows
from tallyloom.plans import base as b
from tallyloom.plans.base import H, query
from tallyloom.sources import counts


@query("""WITH t AS (SELECT id, string_split(id, '/') AS p FROM geo WHERE level <> 'unit'), k AS (SELECT id, row_number() OVER (ORDER BY list_transform(p, lambda x: x::BIGINT)) AS k, len(p) - 1 AS dp FROM t), n AS (SELECT a.id, count(*) AS n FROM t a JOIN t x ON x.id = a.id OR starts_with(x.id, a.id || '/') GROUP BY a.id),
s AS (SELECT id, 2 * k - 1 - dp AS l, 2 * k - 1 - dp + 2 * n - 1 AS r FROM k JOIN n USING (id)) SELECT s.id FROM s, (SELECT l, r FROM s WHERE id = '2') x WHERE s.l BETWEEN x.l AND x.r""")
def subtree_bounds(spark, d):
    """subtree by nested-set containment."""
    from tallyloom.plans import rollups

    s = rollups.nested_sets(spark, d)
    root = s.where("id = '2'").first()
    return read.subtree_bounds(s, root.tree_left, root.tree_right).select("id")


@query("""SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 6 = 0 AND o_totalprice > 100000 THEN 'unavailable' ELSE 'observed' END AS registered_status FROM orders""")
def sentinels(spark, d):
    """zero registered while there are voters is unavailable."""
    o = b.table(spark, d, "orders")
    reg, voters = F.when(F.col("o_orderkey") % 6 == 0, 0).otherwise(500), F.when(F.col("o_totalprice") > 100000, 1).otherwise(0)
    return o.select(F.col("o_orderkey").alias("unit"), text.zero_sentinel(reg, voters).alias("registered_status"))


@query("""SELECT unit, CASE WHEN unit % 7 <> 0 AND unit % 5 <> 0 THEN v + 1 END AS value, CASE WHEN unit % 7 <> 0 AND unit % 5 <> 0 THEN 'observed' WHEN unit % 7 = 0 THEN 'unavailable' ELSE 'unknown' END AS status FROM (SELECT unit, sum(votes)::BIGINT AS v FROM facts GROUP BY unit)""")
def combined_metrics(spark, d):
    """sum of two stateful metrics."""
    s = b.stateful(spark, d).withColumns({"o": F.when(F.col("unit") % 5 != 0, 1), "o_status": F.when(F.col("unit") % 5 != 0, "observed").otherwise("unknown")})
    v, st = text.combined("votes", "o")
    return s.select("unit", v.alias("value"), st.alias("status"))


@query("""SELECT unit, sum(votes) + 2 = t AND t + 1 = w AS complete FROM (SELECT unit, votes, sum(votes) OVER (PARTITION BY unit) + CASE WHEN unit % 4 = 0 THEN 3 ELSE 2 END AS t, sum(votes) OVER (PARTITION BY unit) + 3 AS w FROM facts) GROUP BY unit, t, w""")
def complete_vectors(spark, d):
    """both accounting identities hold."""
    g = b.facts(spark, d).groupBy("unit").agg(F.collect_list("votes").alias("c"), F.sum("votes").alias("s"))
    g = g.withColumn("valid", F.col("s") + F.when(F.col("unit") % 4 == 0, 3).otherwise(2)).withColumn("voters", F.col("s") + 3)
    return g.select("unit", quality.complete_vector(F.col("c"), F.lit(2), F.col("valid"), F.lit(0), F.lit(1), F.col("voters")).alias("complete"))


@query("""SELECT unit, CASE WHEN n < 80 THEN '<80' WHEN n < 150 THEN '80-150' WHEN n < 300 THEN '150-300' ELSE '>=300' END AS band, 'r1|' || department || '|share' AS family, 'r1:place:' || department || ':' || municipality AS ancestor FROM rates""")
def bands_and_ids(spark, d):
    """Bands, family ids, ancestor ids."""
    id_ = F.concat_ws(":", F.lit("r1"), F.lit("place"), *[F.col(c).cast("string") for c in H.levels])
    return b.rates(spark, d).select("unit", text.band(F.col("n"), [80, 150, 300]).alias("band"), text.family_id(F.lit("r1"), F.col("department"), F.lit("share")).alias("family"), text.ancestors(id_)[1].alias("ancestor"))


@query("SELECT unit, department::VARCHAR || ':' || municipality || ':' || place || ':' || unit AS id, department::VARCHAR || ':' || category AS category_key, CASE year WHEN 1995 THEN DATE '1995-05-29' WHEN 1996 THEN DATE '1996-06-19' END AS dated FROM facts")
def canonical_ids(spark, d):
    """Canonical ids, category keys, dates of rounds."""
    s = lambda c: F.col(c).cast("string")
    return b.facts(spark, d).select("unit", text.unit_id(*[s(c) for c in H.levels]).alias("id"), text.category_key(s("department"), F.col("category")).alias("category_key"), text.dated(F.col("year"), {1995: "1995-05-29", 1996: "1996-06-19"}).alias("dated"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 100 THEN round(p_size::DECIMAL(9,4), 4)::DOUBLE END AS percentage, length(lpad(p_size::VARCHAR, 2, '0')) = 2 AS code_ok, starts_with(p_name, 'official-') AS placeholder FROM part""")
def published_values(spark, d):
    """Localised percentages, scope codes, placeholder labels."""
    p = F.col("p_size").cast("string")
    return b.table(spark, d, "part").select("p_partkey", text.localized_percentage(F.concat(F.regexp_replace(p, r"\.", ","), F.lit(" %"))).cast("double").alias("percentage"), text.scope_code_ok(F.lpad(p, 2, "0"), {"zone": 2}, F.lit("zone")).alias("code_ok"), text.is_placeholder(F.col("p_name")).alias("placeholder"))


@query("""SELECT place, round(cos(radians(lat)) * cos(radians(lon)), 9) AS x, round(cos(radians(lat)) * sin(radians(lon)), 9) AS y, round(sin(radians(lat)), 9) AS z FROM (SELECT c_custkey AS place, 10 + (c_custkey % 97) / 250.0 AS lat, -75 + (c_custkey * 7 % 89) / 250.0 AS lon FROM customer)""")
def sphere(spark, d):
    """X17, X23."""
    c = F.col("c_custkey")
    x, y, z = stats.unit_sphere(10 + (c % 97) / 250.0, -75 + (c * 7 % 89) / 250.0)
    return b.table(spark, d, "customer").select(c.alias("place"), F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"))


@query("""SELECT unit, department, 'x' AS signal_type FROM units WHERE unit % 5 = 0 AND department = 3""")
def review_signals(spark, d):
    """signals by type and by any ancestor."""
    s = b.units(spark, d).select("unit", "department", F.when(F.col("unit") % 5 == 0, "x").otherwise("y").alias("signal_type"), F.array(*[F.concat(F.lit(c), F.col(c).cast("string")) for c in H.levels]).alias("ancestors"))
    return read.signals(s, "x", "department3").drop("ancestors")


@query("SELECT unit, 'contextual_row' AS finding FROM units WHERE unit % 12 = 0")
def contextual_rows(spark, d):
    """Contextual rows stay out of analysis."""
    u = b.units(spark, d).withColumn("grain", F.when(F.col("unit") % 12 == 0, "context").otherwise("mesa"))
    return quality.contextual_rows(u, "grain", ["mesa"], ["unit"])[1]


@query("""SELECT n_regionkey::BIGINT AS dep, n_name AS label, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '*' ELSE n_name END AS matched_label, n_nationkey % 3 = 0 AS used_alias FROM nation""")
def aliases(spark, d):
    """Reviewed aliases, checked one-to-one."""
    n = b.table(spark, d, "nation")
    al = n.where("n_nationkey % 3 = 0").select(F.col("n_regionkey").cast("long").alias("dep"), F.col("n_name").alias("label"), F.concat("n_name", F.lit("*")).alias("target"))
    out, _ = crosswalk.apply_aliases(n.select(F.col("n_regionkey").cast("long").alias("dep"), F.col("n_name").alias("label")), al, ["dep"], "label")
    return out


@query("""SELECT unit, sha256(len(unit::VARCHAR) || ':' || unit || ';3:act;' || len('https://x/' || unit) || ':https://x/' || unit || ';') AS document_id FROM units WHERE unit % 2 = 0""")
def document_index(spark, d):
    """Documents of known units with ids."""
    u = b.units(spark, d)
    docs = u.select("unit", F.lit("act").alias("type"), F.concat(F.lit("https://x/"), F.col("unit").cast("string")).alias("url"))
    known, _ = reconcile.document_index(docs, u.where("unit % 2 = 0"), "unit")
    return known.select("unit", "document_id")


@query("""WITH l AS (SELECT unit, max(votes) FILTER (WHERE category = 'RF') AS rf, max(votes) FILTER (WHERE category = 'NF') AS nf FROM facts GROUP BY unit) SELECT unit, rf AS "RF_numerator", nf AS "NF_numerator", CASE WHEN rf IS NULL THEN 'no_target' WHEN nf IS NULL THEN 'no_NF' END AS excluded FROM l""")
def families(spark, d):
    """Target rows with the other metrics of the same unit, exclusions with reasons."""
    long = b.facts(spark, d).select("unit", F.col("category").alias("metric"), F.col("votes").alias("numerator"), F.lit(100).alias("denominator"))
    return read.family_rows(long, "unit", "RF", ["NF"]).select("unit", "RF_numerator", "NF_numerator", "excluded")


@query("""SELECT unit, CASE WHEN place % 3 <> 0 THEN lpad(place::VARCHAR, 8, '0') END AS place, CASE WHEN place % 3 = 0 THEN 'unknown_place' END AS finding FROM units""")
def bound_units(spark, d):
    """Units bound to places by the beginning of their codes."""
    u = b.units(spark, d)
    code = F.lpad(F.col("place").cast("string"), 8, "0")
    return read.bound_units(u.select("unit", F.concat(code, F.col("unit").cast("string")).alias("code")), u.where("place % 3 <> 0").select(code.alias("p")), "code", "p", 8).select("unit", "place", "finding")


@query("""WITH m AS (SELECT *, count(*) OVER (PARTITION BY unit, category) AS n FROM (SELECT department, unit, category, votes FROM facts UNION ALL SELECT department, unit, category, votes FROM facts WHERE unit % 20 = 0)) SELECT department::VARCHAR AS id, category, sum(votes)::BIGINT AS votes FROM m WHERE n = 1 GROUP BY ALL""")
def exact_rollups(spark, d):
    """A5: duplicated identities are reported and left out."""
    f = b.facts(spark, d)
    r, _ = rollup.exact_rollup(f.unionByName(f.where("unit % 20 = 0")), H, "unit", ["category"], "votes")
    return r.where("level = 'department'").select("id", "category", "votes")


@query("""WITH c AS (SELECT *, sum(eligible::INT) OVER (PARTITION BY place) - eligible::INT AS n1, sum(eligible::INT) OVER (PARTITION BY municipality) - eligible::INT AS n2, sum(eligible::INT) OVER (PARTITION BY department) - eligible::INT AS n3 FROM rates),
p AS (SELECT department, CASE WHEN NOT eligible THEN NULL WHEN n1 >= 30 THEN 'place' WHEN n2 >= 30 THEN 'municipality' WHEN n3 >= 30 THEN 'department' END AS pool, CASE WHEN n1 >= 30 THEN n1 WHEN n2 >= 30 THEN n2 ELSE n3 END AS peers FROM c)
SELECT department, pool, count(*) AS units, min(peers)::BIGINT AS least_peers, max(peers)::BIGINT AS most_peers FROM p GROUP BY ALL""")
def cohorts(spark, d):
    """Which pools served, and their sizes."""
    r = windows.fallback_pool(b.rates(spark, d), ["place", "municipality", "department"], F.col("eligible"), 30)
    return read.cohort_registry(r, "department", "pool", "peers")


@query("""SELECT municipality, sum(votes)::BIGINT AS votes, count(DISTINCT unit) AS units_reported FROM facts GROUP BY municipality""")
def reported_rollup(spark, d):
    """Rollup by walking parents, with units reported."""
    walk = rollup.lineage(b.geo(spark, d), list(H.levels)).select(F.col("unit").alias("id"), F.col("municipality").alias("m"))
    f = b.facts(spark, d).withColumn("id", H.path("unit"))
    g = f.join(walk, "id").groupBy("m").agg(F.sum("votes").alias("votes"), F.countDistinct("unit").alias("units_reported"))
    return g.select(F.split("m", "/")[1].cast("long").alias("municipality"), "votes", "units_reported")


@query("""WITH c AS (SELECT c_custkey % 200 AS u, min(c_nationkey % 3) AS m, bool_and(c_custkey % 9 <> 0) AS ok, count(DISTINCT c_custkey % 400) AS k, avg(CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END) AS r, min(c_custkey % 400) AS la FROM customer GROUP BY 1)
SELECT u::BIGINT AS u, CASE WHEN NOT ok THEN 'invalid' WHEN k > 1 THEN 'inconsistent' WHEN sum((ok AND k = 1)::INT) OVER (PARTITION BY m, la) > 1 THEN 'colocated' ELSE 'ok' END AS status FROM c""")
def spatial_units(spark, d):
    """Units from rows, with consistency and co-location checks."""
    k = F.col("c_custkey")
    rows = b.table(spark, d, "customer").select((k % 200).alias("u"), (F.col("c_nationkey") % 3).alias("m"), (k % 400).cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.col("c_acctbal").alias("r"), F.when(k % 9 == 0, 900.0).otherwise(5.0).alias("acc"), F.lit(False).alias("cross"))
    return screens.spatial_units(rows, "u", "m", "lat", "lon", "r", "acc", "cross").select("u", "status")


@query("""WITH c AS (SELECT category, sum(votes)::BIGINT AS computed FROM facts GROUP BY category) SELECT category, CASE WHEN category <> 'AF' THEN computed + (category = 'RF')::INT END AS declared, computed, category NOT IN ('AF', 'RF') AS equal FROM c""")
def summary_rollup(spark, d):
    """A declared summary against the sum of its units; one total is wrong and one missing."""
    f = b.facts(spark, d)
    s = f.where("category <> 'AF'").groupBy("category").agg(F.sum("votes").alias("votes")).withColumn("votes", F.col("votes") + (F.col("category") == "RF").cast("int"))
    return rollup.summary_check(s, f, ["category"], "votes")


@query("""SELECT unit AS id, 'k' || (unit % 2) AS kind, string_agg(DISTINCT category, ';' ORDER BY category) AS components FROM facts GROUP BY unit""")
def anomaly_components(spark, d):
    """A26."""
    a = b.facts(spark, d).select(F.col("unit").alias("id"), F.concat(F.lit("k"), (F.col("unit") % 2).cast("string")).alias("kind"), "category")
    return read.anomaly_components(a, "id", "kind", "category").withColumn("components", F.array_join("components", ";"))


@query("""SELECT 'https://a/' || unit AS url FROM units WHERE unit % 3 <> 0""")
def unit_lists(spark, d):
    """Unit lists of place documents; foreign prefixes are findings."""
    url = F.concat(F.when(F.col("unit") % 3 == 0, "http://b/").otherwise("https://a/"), F.col("unit").cast("string"))
    docs = b.units(spark, d).groupBy("place").agg(F.to_json(F.struct(F.collect_list(F.struct(url.alias("url"))).alias("mapagan"))).alias("raw"))
    return counts.unit_list(docs, "raw", "https://a/")[0]


@query("""SELECT department AS bundle, unit AS anomaly, category AS component FROM facts""")
def analysis_bundles(spark, d):
    """Bundles as artifact, anomaly, component and report rows."""
    f = b.facts(spark, d).groupBy("department", "place", "unit").agg(F.collect_list("category").alias("components"))
    docs = f.groupBy("department", "place").agg(F.collect_list(F.struct(F.col("unit").alias("anomaly_id"), "components")).alias("anomalies"))
    none = F.array().cast("array<struct<name:string>>")
    docs = docs.select(F.col("department").alias("bundle_id"), "anomalies", none.alias("artifacts"), none.alias("reports"))
    c = counts.analysis_bundle(docs)["components"]
    return c.select(F.col("bundle_id").alias("bundle"), F.col("anomaly_id").alias("anomaly"), "component")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_metrics(spark, d):
    """Values out of raw payloads."""
    return b.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
