"""Queries on releases with faults in them: relations, frozen totals, provenance, bundles, reports and screens that fire."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import quality, rollup, screens, windows
from tallyloom.plans import base as b
from tallyloom.plans.base import H, query
from tallyloom.sources import counts


def _text(c: str):
    return F.col(c).cast("string")


@query("""WITH r AS (SELECT year, count(*) AS n, sum(votes)::BIGINT AS v FROM facts GROUP BY year), top AS (SELECT max(year) AS y FROM r)
SELECT year, CASE WHEN year % 5 <> 4 THEN n END AS rows, CASE WHEN year % 5 <> 4 THEN v END AS total, CASE WHEN year % 5 <> 3 THEN n + (year % 5 = 2)::INT END AS want_rows, CASE WHEN year % 5 <> 3 THEN v - (year % 5 = 1)::INT END AS want_total, year % 5 = 0 AS ok FROM r""")
def frozen_totals(spark, d):
    """Totals by year against frozen ones: a wrong number of rows, a wrong sum, a year on one side only."""
    f, k = b.facts(spark, d), F.col("year") % 5
    frozen = f.groupBy("year").agg(F.count("*").alias("rows"), F.sum("votes").alias("total")).where(k != 3)
    frozen = frozen.select("year", (F.col("rows") + (k == 2).cast("int")).alias("rows"), (F.col("total") - (k == 1).cast("int")).alias("total"))
    return rollup.control_totals(f.where(k != 4), "year", "votes", frozen)


@query("""WITH f AS (SELECT department AS release, concat_ws('/', department, municipality, place, unit) AS id, place, unit, unit % 17 = 0 AS lost, unit % 19 = 0 AS level, unit % 23 = 0 AS bare, unit % 29 = 0 AS gone, unit % 31 = 0 AS dropped FROM units),
x AS (SELECT release, 'fact' AS record, id, unnest(list_filter([CASE WHEN lost THEN 'unknown_geography' END, CASE WHEN NOT lost AND level THEN 'wrong_level' END, CASE WHEN NOT lost AND bare THEN 'no_unit' END, CASE WHEN NOT bare AND gone THEN 'unknown_unit' END], lambda y: y IS NOT NULL)) AS finding FROM f WHERE NOT dropped
UNION ALL SELECT release, 'fact', id, 'unit_above_its_level' FROM (SELECT DISTINCT department AS release, concat_ws('/', department, municipality, place) AS id, place FROM units) WHERE place % 7 = 0
UNION ALL SELECT release, 'category', id, 'no_fact' FROM f JOIN (SELECT DISTINCT unit, category FROM facts) USING (unit) WHERE dropped
UNION ALL SELECT split_part(id, '/', 1)::BIGINT, 'geography', id, 'orphan' FROM geo WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM geo WHERE level <> 'municipality' OR id NOT LIKE '%5') AND (level <> 'unit' OR split_part(id, '/', 4)::BIGINT % 17 <> 0) AND (level <> 'municipality' OR id NOT LIKE '%5'))
SELECT * FROM x""")
def relation_findings(spark, d):
    """Facts, categories and places of releases whose references are broken in every way."""
    u, k = b.units(spark, d), F.col("unit")
    release, place = F.col("department").alias("release"), H.path("place")
    geo = b.geo(spark, d).withColumn("release", F.split("id", "/")[0].cast("long"))
    lost = ((F.col("level") == "unit") & (F.split("id", "/")[3].cast("long") % 17 == 0)) | ((F.col("level") == "municipality") & F.col("id").like("%5"))
    kept = k % 31 != 0
    low = u.select(release, H.path("unit").alias("id"), k, F.when(k % 19 == 0, "place").otherwise("unit").alias("geography_level"), F.when(k % 23 != 0, k.cast("string")).alias("unit_id"))
    any_unit = u.where(k % 29 != 0).groupBy("department", "municipality", "place").agg(F.min("unit").alias("one"))
    high = u.select("department", "municipality", "place").distinct().join(any_unit, ["department", "municipality", "place"], "left")
    high = high.select(release, place.alias("id"), F.lit("place").alias("geography_level"), F.when(F.col("place") % 7 == 0, F.coalesce(F.col("one").cast("string"), F.lit("any"))).alias("unit_id"))
    facts = low.where(kept).drop("unit").unionByName(high).withColumn("geography_id", F.col("id"))
    known = u.where(k % 29 != 0).select(release, k.cast("string").alias("id")).unionByName(u.select(release, F.lit("any").alias("id")))
    cats = b.facts(spark, d).select(release, H.path("unit").alias("fact_id"))
    return quality.relation_findings(geo.where(~lost), known, facts, cats, ["release"], "unit")


@query("""SELECT l_linestatus AS round, count(*) AS provenances, count(*) FILTER (WHERE l_returnflag = 'N') AS unknown FROM (SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem) GROUP BY 1 HAVING count(*) > 1 OR count(*) FILTER (WHERE l_returnflag = 'N') > 0""")
def provenance_unknown(spark, d):
    """Q8: provenance that no known source has, and rounds of several."""
    l = b.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("round"), "l_returnflag")
    return quality.provenance_constant(l, "round", ["l_returnflag"], l.where("l_returnflag <> 'N'"))


@query("""WITH s AS (SELECT place, unit, k + k // 4 AS seq, CASE WHEN unit % 5 <> 0 THEN CASE WHEN unit % 2 = 0 THEN 'x' ELSE 'y' END END AS c FROM (SELECT place, unit, row_number() OVER (PARTITION BY place ORDER BY unit) AS k FROM units)),
g AS (SELECT *, seq - row_number() OVER (PARTITION BY place ORDER BY seq) AS island FROM s WHERE c IS NOT NULL) SELECT place, min(unit) AS first_unit, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, string_agg(c, '' ORDER BY seq) AS kinds FROM g GROUP BY place, island""")
def place_blocks(spark, d):
    """A place's rows in runs of consecutive numbers, by the library's own operator."""
    n = b.units(spark, d).select("place", "unit", F.expr("row_number() over (partition by place order by unit)").alias("k"))
    s = n.select("place", "unit", (F.col("k") + F.floor(F.col("k") / 4)).alias("seq"), F.when(F.col("unit") % 5 != 0, F.when(F.col("unit") % 2 == 0, "x").otherwise("y")).alias("c"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda x: x["c"]), "")
    g = windows.blocks(s, ["place"], "seq", "c").groupBy("place", "block")
    return g.agg(F.min("unit").alias("first_unit"), F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), kinds.alias("kinds")).drop("block")


@query("""WITH g AS (SELECT year AS slug, 'nation' AS level, 'N' AS id, o_orderdate AS date, unit, place FROM units UNION ALL SELECT year, 'municipality', 'M' || municipality, o_orderdate, unit, place FROM units),
p AS (SELECT slug, level, id, min(date) AS d, min(place) AS r FROM g GROUP BY ALL), c AS (SELECT slug, id, count(DISTINCT category) AS k FROM g JOIN facts USING (unit) GROUP BY ALL)
SELECT slug, min(r) AS first_round, min(d) AS first_date, count(*) AS places, sum(k)::BIGINT AS categories, max(CASE WHEN level = 'nation' THEN id END) AS top_id FROM p JOIN c USING (slug, id) GROUP BY slug""")
def release_statistics(spark, d):
    """By year, over the nation and its municipalities with their counts of categories."""
    levels = F.explode(F.array(F.struct(F.lit("nation").alias("level"), F.lit("N").alias("id")), F.struct(F.lit("municipality").alias("level"), F.concat(F.lit("M"), _text("municipality")).alias("id"))))
    u = b.units(spark, d).select(F.col("year").alias("slug"), "unit", "place", "o_orderdate", levels.alias("g")).select("*", "g.*").drop("g")
    geo = u.groupBy("slug", "level", "id").agg(F.min("o_orderdate").alias("date"), F.min("place").alias("round"))
    k = u.join(b.facts(spark, d).select("unit", "category"), "unit").groupBy("slug", "id").agg(F.countDistinct("category").alias("category_count"))
    return rollup.release_statistics(geo, k, ["slug"], ["round", "date"], "nation")


_REPORTED = "r AS (SELECT department, unit, category, CASE WHEN unit % 7 <> 0 THEN votes END AS v FROM facts WHERE unit % 13 <> 0), n AS (SELECT department, count(*) AS units FROM units GROUP BY ALL)"


@query(f"""WITH {_REPORTED} SELECT department::VARCHAR AS id, count(DISTINCT unit) AS units_reported, any_value(units) AS units, coalesce(sum(v), 0)::BIGINT AS votes FROM n LEFT JOIN r USING (department) GROUP BY department""")
def reported_departments(spark, d):
    """Departments from the units reported so far, by walking parents."""
    return _reported(spark, d)[0]


@query(f"WITH {_REPORTED} SELECT department::VARCHAR AS id, category, sum(v)::BIGINT AS votes FROM r GROUP BY department, category HAVING count(v) > 0")
def reported_candidates(spark, d):
    """Their categories."""
    return _reported(spark, d)[1]


def _reported(spark, d):
    ok = F.col("unit") % 7 != 0
    f = b.facts(spark, d).where("unit % 13 <> 0").select(H.path("unit").alias("id"), "category", F.when(ok, F.col("votes")).alias("votes"), F.when(ok, "observed").otherwise("unavailable").alias("votes_status"))
    return rollup.reported_rollup(f, b.geo(spark, d), list(H.levels), "department", b.VOTES, "category")


@query("""WITH s AS (SELECT unit, n, CASE WHEN unit % 7 <> 0 THEN y END AS y FROM rates) SELECT unit, '{"valid":{"value":' || n || ',"status":"observed"},"blank":{"value":' || coalesce(y::VARCHAR, 'null') || ',"status":"' || CASE WHEN y IS NULL THEN 'unavailable' ELSE 'observed' END || '"},"registered":{"value":null,"status":"unavailable"}}' AS metrics,
  n AS valid, y AS blank, NULL::BIGINT AS registered, CASE WHEN y IS NULL THEN 'unavailable' ELSE 'observed' END AS blank_status, 'unavailable' AS registered_status FROM s""")
def metric_objects(spark, d):
    """Metrics of derived facts as JSON in a fixed order, and their values and states read out of it."""
    y = F.when(F.col("unit") % 7 != 0, F.col("y"))
    m = b.rates(spark, d).select("unit", text.metric_object({"valid": F.col("n"), "blank": y, "registered": None}).alias("metrics"))
    values = [text.metric_value(F.col("metrics"), c).alias(c) for c in ("valid", "blank", "registered")]
    return m.select("unit", "metrics", *values, *[text.metric_status(F.col("metrics"), c).alias(f"{c}_status") for c in ("blank", "registered")])


@query("""SELECT page_id, url LIKE 'https://%' AND lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), ':', 1)) IN ('thther.example.org', 'm.ththth.example.net', 'blog.ththan.example.net') AS allowed FROM pages""")
def audited_hosts(spark, d):
    """Pages against a list of hosts, https only."""
    return b.table(spark, d, "pages").select("page_id", text.https_ok(F.col("url"), ["thther.example.org", "m.ththth.example.net", "blog.ththan.example.net"]).alias("allowed"))


@query("""WITH p AS (SELECT department AS bundle, place, count(DISTINCT unit) AS n FROM facts GROUP BY ALL) SELECT bundle, 'artifact' AS kind, 'a' || place AS name, sha256(place::VARCHAR) AS detail FROM p
UNION ALL SELECT bundle, 'report', 'r' || place, n::VARCHAR FROM p WHERE place % 2 = 0 UNION ALL SELECT department, 'anomaly', unit::VARCHAR, k::VARCHAR FROM (SELECT department, unit, count(*) AS k FROM facts GROUP BY ALL) UNION ALL SELECT department, 'component', unit::VARCHAR, category FROM facts""")
def bundle_tables(spark, d):
    """All four tables of analysis bundles."""
    f = b.facts(spark, d).groupBy("department", "place", "unit").agg(F.collect_list("category").alias("components"))
    g = f.groupBy("department", "place").agg(F.collect_list(F.struct(_text("unit").alias("anomaly_id"), F.size("components").alias("parts"), "components")).alias("anomalies"), F.count("*").alias("n"))
    name = lambda x: F.concat(F.lit(x), _text("place")).alias("name")
    report = F.struct(name("r"), _text("n").alias("rows"))
    docs = g.select(F.col("department").alias("bundle_id"), "anomalies", F.array(F.struct(name("a"), F.sha2(_text("place"), 256).alias("sha256"))).alias("artifacts"), F.filter(F.array(report), lambda _: F.col("place") % 2 == 0).alias("reports"))
    t = counts.analysis_bundle(docs)
    row = lambda n, kind, name, detail: t[n].select(F.col("bundle_id").alias("bundle"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(detail).cast("string").alias("detail"))
    return row("artifacts", "artifact", "name", "sha256").unionByName(row("reports", "report", "name", "rows")).unionByName(row("anomalies", "anomaly", "anomaly_id", "parts")).unionByName(row("components", "component", "anomaly_id", "component"))


@query("""WITH e AS (SELECT *, sum(eligible::INT) OVER (PARTITION BY place) - eligible::INT AS k1, sum(eligible::INT) OVER (PARTITION BY municipality) - eligible::INT AS k2, sum(eligible::INT) OVER (PARTITION BY department) - eligible::INT AS k3 FROM rates)
SELECT unit, CASE WHEN k1 >= 30 THEN k1 WHEN k2 >= 30 THEN k2 ELSE k3 END::BIGINT AS peers FROM e WHERE eligible AND unit % 499 = 0 AND CASE WHEN k1 >= 30 THEN k1 WHEN k2 >= 30 THEN k2 ELSE k3 END >= 200""")
def research_signals(spark, d):
    """The research endpoint on a screen's own output. Counts lie near 40 % but for every 499th unit's 95 %: those it must find, no others."""
    k, n = F.col("unit"), F.floor(F.col("n") / 20) * 20
    share = F.when(k % 499 == 0, 0.95).otherwise(0.4 + (k * 7919 % 11 + k * 104729 % 13 - 11) / 80)
    r = b.rates(spark, d).select("department", "municipality", "place", "unit", n.alias("n"), F.floor(n * share).alias("y"), "eligible", F.lit("share").alias("family"))
    s = screens.peer_screen(r, "family", "unit", ["place", "municipality", "department"], "y", "n", "eligible")
    return screens.research_endpoint(s, F.lit(False)).select("unit", "peers")
