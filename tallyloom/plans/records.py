"""Queries on file dialects, manifests, stores, payloads and records of single units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import quality, read, reconcile, score, screens
from tallyloom.plans import base as b
from tallyloom.plans.base import query
from tallyloom.plans.comparisons import COMPARED
from tallyloom.plans.feeds import _folder
from tallyloom.sources import counts, tables


def _text(c: str):
    return F.col(c).cast("string")


@query("""SELECT lpad(department::VARCHAR, 2, '0') AS dep, 'official-department-code-' || department AS dep_name, CASE WHEN unit % 3 = 0 THEN 'official-candidate-code-' || category ELSE 'Name ' || category END AS category_name,
  count(*) AS rows, sum(votes)::BIGINT AS votes FROM facts GROUP BY ALL""")
def dialect_files(spark, d):
    """Another column layout without labels of departments, read by the same rules."""
    raw = b.facts(spark, d).select(_text("department").alias("d"), _text("municipality").alias("m"), (F.col("unit") % 1000000).cast("string").alias("t"), F.col("category").alias("c"), F.when(F.col("unit") % 3 != 0, F.concat(F.lit("Name "), "category")).alias("name"), _text("votes").alias("v"), F.lit("1").alias("one"))
    columns = dict.fromkeys(counts.HEADER) | {"DEP": "d", "MUN": "m", "MESA": "t", "CAN": "c", "CANNOMBRE": "name", "VOTOS": "v", "ZONA": "one", "PUESTO": "one"}
    fixed = counts.with_dialect(raw, columns, {"DEPNOMBRE": ("department", "DEP"), "MUNNOMBRE": ("municipality", "MUN"), "CANNOMBRE": ("candidate", "CAN")})
    good, _ = counts.split_counts(fixed)
    return good.groupBy("dep", "dep_name", "category_name").agg(F.count("*").alias("rows"), F.sum("votes").alias("votes"))


@query("""SELECT unit, CASE WHEN unit % 5 = 0 THEN 'unplanned' WHEN unit % 4 = 0 THEN 'scope_mismatch' ELSE 'planned' END AS state FROM units""")
def scoped_documents(spark, d):
    """Documents whose scope must be the planned one."""
    u = b.units(spark, d).select("unit", _text("department").alias("scope"))
    plan = u.where("unit % 5 <> 0").withColumn("scope", F.when(F.col("unit") % 4 == 0, "other").otherwise(F.col("scope")))
    ok, bad = counts.scoped_documents(u, plan, ["unit"], "scope")
    return ok.select("unit", F.lit("planned").alias("state")).unionByName(bad.select("unit", F.col("reason").alias("state")))


@query("SELECT department::VARCHAR AS code, count(*) AS rows, sum(y)::BIGINT AS women, sum(n - y)::BIGINT AS men, sum(n)::BIGINT AS total FROM rates GROUP BY department")
def census_files(spark, d):
    """Arrays of census rows written as files, one array a line, and read back."""
    path = _folder(spark, "census")
    row = F.struct(_text("department").alias("COD_DEPTO"), _text("municipality").alias("COD_MUN"), F.col("y").alias("MUJERES"), (F.col("n") - F.col("y")).alias("HOMBRES"), F.col("n").alias("TOTAL"))
    b.rates(spark, d).groupBy("place").agg(F.to_json(F.collect_list(row)).alias("value")).select("value").write.text(path)
    c = counts.census(spark, path, multi_line=False)
    return c.groupBy(F.col("COD_DEPTO").alias("code")).agg(F.count("*").alias("rows"), F.sum("MUJERES").alias("women"), F.sum("HOMBRES").alias("men"), F.sum("TOTAL").alias("total"))


@query("SELECT unit, n AS votes FROM rates")
def catalog_files(spark, d):
    """Attributes of feature collections written as files, one collection a line, and read back."""
    path = _folder(spark, "features")
    feature = F.struct(F.struct("unit", F.col("n").alias("votes")).alias("attributes"))
    b.rates(spark, d).groupBy("place").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).select("value").write.text(path)
    return counts.catalog_features(spark, path, "unit: bigint, votes: bigint", multi_line=False)


@query("""SELECT 'p' || unit AS prefix, 'https://x/p' || unit || '/f' || unit // 2 || '.json' AS url, count(*) OVER (PARTITION BY unit // 2) > 1 AS repeated FROM units""")
def index_plans(spark, d):
    """Index objects as plans of files; files under several prefixes are findings."""
    u = b.units(spark, d).select("place", F.concat(F.lit("p"), _text("unit")).alias("k"), F.concat(F.lit("f"), F.floor(F.col("unit") / 2).cast("string"), F.lit(".json")).alias("v"))
    docs = u.groupBy("place").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("raw"))
    plan, bad = counts.index_plan(docs, "raw", "https://x/")
    return plan.join(bad, "file", "left").select("prefix", "url", F.col("prefixes").isNotNull().alias("repeated"))


@query("""SELECT DISTINCT unnest(regexp_extract_all(t, '(https?://[^\\s\"''<>\\\\]+)', 1)) AS url FROM (SELECT text AS t FROM documents UNION ALL SELECT html || ' ' || url FROM pages)""")
def declared_urls(spark, d):
    """Distinct URLs of whole documents and pages."""
    docs = b.table(spark, d, "documents").select(F.col("text").alias("t")).unionByName(b.table(spark, d, "pages").select(F.concat("html", F.lit(" "), "url").alias("t")))
    return counts.declared_urls(docs, "t")


@query("SELECT f AS format, municipality, category, sum(votes)::BIGINT AS votes FROM facts, (SELECT unnest(['parquet', 'json', 'csv']) AS f) GROUP BY ALL")
def research_outputs(spark, d):
    """A research table in every format, read back."""
    folder = _folder(spark, "outputs")
    totals = b.facts(spark, d).groupBy("municipality", "category").agg(F.sum("votes").alias("votes"))
    tables.write_outputs({"totals": totals}, folder)
    r = spark.read.schema(totals.schema)
    found = {"parquet": r.parquet(f"{folder}/totals.parquet"), "json": r.json(f"{folder}/totals.json"), "csv": r.option("header", True).csv(f"{folder}/totals.csv")}
    out = [df.select(F.lit(f).alias("format"), "municipality", "category", "votes") for f, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT unit, CASE WHEN unit % 2 = 0 THEN '''=' ELSE '' END || 'p' || place AS label, CASE WHEN unit % 7 <> 0 THEN sum(votes)::BIGINT END AS votes, CASE WHEN unit % 7 <> 0 THEN 'observed' ELSE 'unavailable' END AS votes_status FROM facts GROUP BY unit, place""")
def stateful_downloads(spark, d):
    """Flat download columns with states beside values."""
    s = b.stateful(spark, d).select("unit", F.concat(F.when(F.col("unit") % 2 == 0, "=").otherwise(""), F.lit("p"), _text("place")).alias("label"), F.struct(F.col("votes").alias("value"), F.col("votes_status").alias("status")).alias("votes"))
    return s.select(*counts.stateful_csv(s, ["votes"]))


@query("SELECT 'r2' AS release_id, unit, n AS votes, CASE WHEN unit % 2 = 0 THEN 'even' END AS kind FROM rates WHERE department = 2")
def federated_stores(spark, d):
    """Two stores of different columns as one, pruned to a release."""
    folder = _folder(spark, "stores")
    r = b.rates(spark, d).select(F.concat(F.lit("r"), _text("department")).alias("release_id"), "unit", F.col("n").alias("votes"))
    tables.load_release({"even": r.where("unit % 2 = 0").withColumn("kind", F.lit("even")), "odd": r.where("unit % 2 = 1")}, folder, ["release_id"])
    return tables.federated(spark, [f"{folder}/even", f"{folder}/odd"], "r2").select("release_id", "unit", "votes", "kind")


@query("SELECT place AS release_id, category AS name, count(*) AS rows, sha256(place || category) AS sha256 FROM facts GROUP BY place, category")
def dataset_catalogues(spark, d):
    """Datasets of release manifests."""
    f = b.facts(spark, d).groupBy("place", "category").agg(F.count("*").alias("rows"))
    one = F.struct(F.col("category").alias("name"), "rows", F.sha2(F.concat(_text("place"), "category"), 256).alias("sha256"))
    return tables.dataset_catalogue(f.groupBy(F.col("place").alias("release_id")).agg(F.collect_list(one).alias("datasets")))


@query("""WITH p AS (SELECT place, count(*) AS n FROM units GROUP BY place), f AS (SELECT place AS release_id, 'source_hash' AS finding FROM units WHERE unit % 4 = 0 UNION ALL SELECT place, 'source_timestamp' FROM units WHERE unit % 5 = 0 UNION ALL SELECT place, 'source_url' FROM units WHERE unit % 6 = 0
UNION ALL SELECT place, 'no_datasets' FROM p WHERE place % 3 = 0 UNION ALL SELECT place, 'dataset_hash' FROM p WHERE place % 3 <> 0 AND place % 4 = 0 UNION ALL SELECT place, 'dataset_rows' FROM p WHERE place % 3 <> 0 AND place % 5 = 0 UNION ALL SELECT place, 'coverage_identity' FROM p WHERE place % 7 = 0)
SELECT release_id, finding, count(*) AS n FROM f GROUP BY ALL""")
def manifest_findings(spark, d):
    """Manifests with hashes, timestamps, URLs, row counts and coverage that may be wrong."""
    u, p = F.col("unit"), F.col("place")
    source = F.struct(F.when(u % 4 == 0, "zz").otherwise(F.sha2(_text("unit"), 256)).alias("content_hash"), F.concat(F.lit("2024-01-01T00:00:00"), F.when(u % 5 == 0, "").otherwise("Z")).alias("retrieved_at"), F.when(u % 6 == 0, "http://x").otherwise("https://x").alias("url"))
    g = b.units(spark, d).groupBy("place").agg(F.collect_list(source).alias("sources"), F.count("*").alias("n"))
    dataset = F.struct(F.when(p % 4 == 0, "x").otherwise(F.sha2(_text("place"), 256)).alias("sha256"), F.when(p % 5 == 0, -1).otherwise(F.col("n")).alias("rows"))
    got = F.col("n") - (p % 7 == 0).cast("int")
    coverage = F.struct(F.col("n").alias("expected"), got.alias("retrieved"), got.alias("parsed"), *[F.lit(0).alias(c) for c in ("missing", "ambiguous", "excluded")])
    docs = g.select(p.alias("release_id"), "sources", F.when(p % 3 == 0, F.array().cast("array<struct<sha256: string, rows: bigint>>")).otherwise(F.array(dataset)).alias("datasets"), coverage.alias("coverage"))
    return quality.manifests(docs).groupBy("release_id", "finding").agg(F.count("*").alias("n"))


@query(f"""WITH {COMPARED} SELECT 'evidence' AS record, '{{"category":"' || category || '","source":"' || source || '","votes":' || votes || '}}' AS detail FROM sources WHERE unit = 7
UNION ALL SELECT 'comparison', '{{"comparable":' || comparable || ',"difference":' || coalesce(CASE WHEN comparable THEN diff END::VARCHAR, 'null') || ',"min_edits":' || coalesce(CASE WHEN comparable THEN greatest(up, down)::BIGINT END::VARCHAR, 'null') || '}}' FROM c WHERE unit = 7""")
def unit_records(spark, d):
    """evidence and comparisons of one unit."""
    s = b.sources(spark, d)
    return read.unit_records({"evidence": s, "comparison": reconcile.compare_sources(s, "source", "a", "b", ["unit"], "category", "votes")}, "unit", 7)


@query("""SELECT unit, coalesce(max(CASE WHEN l_linenumber = 1 THEN 100 WHEN l_linenumber = 4 THEN 25 ELSE 0 END), 0)::BIGINT AS score FROM units LEFT JOIN lineitem ON unit = l_orderkey GROUP BY unit""")
def priority_order(spark, d):
    """O3: units by priority, highest first, then id."""
    e = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.when(F.col("l_linenumber") == 1, "accounting_failure").when(F.col("l_linenumber") == 4, "coverage").otherwise("statistic").alias("kind"), F.lit(0).cast("long").alias("edits"))
    return read.by_priority(score.audit_priority(b.units(spark, d), e, "unit"), "score", "unit").select("unit", "score")


@query("""SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS label, o_orderkey % 2 = 1 AS hash_ok, CASE WHEN o_orderkey % 3 <> 0 THEN epoch(o_orderdate)::BIGINT END AS at FROM orders""")
def formats(spark, d):
    """Required texts, digests, timestamps with zones."""
    o, k = b.table(spark, d, "orders"), F.col("o_orderkey")
    label = F.when(k % 4 == 0, "   ").otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))
    sha = F.when(k % 2 == 1, F.sha2(k.cast("string"), 256)).otherwise(F.upper(F.sha2(k.cast("string"), 256)))
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00"), F.when(k % 3 == 0, "").otherwise("Z"))
    return o.select(k.alias("unit"), text.clean(label).alias("label"), text.is_sha256(sha).alias("hash_ok"), F.unix_timestamp(text.zoned_timestamp(at)).alias("at"))


@query(r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' +1 555-123-4567' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' Cedula: 12345678' ELSE '' END AS t FROM documents)
SELECT doc_id, regexp_matches(t, '(\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-]?[0-9]{4}') AS phone, regexp_matches(t, '(?i)\b(cc|c\.c\.|cedula|passport|ssn)[ :#-]*[0-9]{6,10}\b') AS id_document FROM t""")
def contact_findings(spark, d):
    """Telephone numbers and identity documents in whole texts."""
    i = F.col("doc_id")
    t = F.concat("text", F.when(i % 3 == 0, " +1 555-123-4567").otherwise(""), F.when(i % 5 == 0, " Cedula: 12345678").otherwise(""))
    found = b.table(spark, d, "documents").select("doc_id", text.personal_findings(t).alias("f"))
    return found.select("doc_id", *[F.array_contains("f", n).alias(n) for n in ("phone", "id_document")])


@query("""SELECT page_id, coalesce(starts_with(url, 'https://') AND ends_with(host, '.org'), false) AS allowed FROM (SELECT page_id, url, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), '')) AS host FROM pages)""")
def allowed_hosts(spark, d):
    """Https URLs of allowed hosts, here all that end in .org."""
    p = b.table(spark, d, "pages")
    allowed = p.select(text.host(F.col("url")).alias("host")).where("host like '%.org'").distinct().withColumn("ok", F.lit(True))
    j = p.withColumn("host", text.host(F.col("url"))).join(allowed, "host", "left")
    return j.select("page_id", (F.coalesce("ok", F.lit(False)) & F.col("url").startswith("https://")).alias("allowed"))


@query("""SELECT unit, fit, peers, z FROM (SELECT unit, CASE WHEN unit % 5 = 0 THEN 'moments' ELSE 'likelihood' END AS fit, n * 3 AS peers, (unit % 11 - 5)::DOUBLE AS z, (unit % 23 - 11)::DOUBLE AS e, (unit % 4) / 3000.0 AS p, (unit % 3) / 30.0 AS q, unit % 2 = 0 AS special FROM rates)
WHERE fit = 'likelihood' AND peers >= 200 AND p <= 0.001 AND q <= 0.05 AND abs(z) >= 3.5 AND abs(e) >= CASE WHEN special THEN 3 ELSE 8 END""")
def research_rows(spark, d):
    """The research endpoint's rule on screened rows."""
    u = F.col("unit")
    s = b.rates(spark, d).select("unit", F.when(u % 5 == 0, "moments").otherwise("likelihood").alias("fit"), (F.col("n") * 3).alias("peers"), (u % 11 - 5).cast("double").alias("z"), (u % 23 - 11).cast("double").alias("effect_points"), ((u % 4) / 3000).alias("p"), ((u % 3) / 30).alias("q"))
    return screens.research_endpoint(s, u % 2 == 0).select("unit", "fit", "peers", "z")


@query("""SELECT unit, m AS metric, CASE m WHEN 'turnout' THEN n WHEN 'candidate_share' THEN y WHEN 'blank' THEN 1 ELSE 2 END::BIGINT AS numerator, CASE m WHEN 'turnout' THEN n + 10 WHEN 'null_unmarked' THEN n ELSE n - 2 END::BIGINT AS denominator
FROM rates, (SELECT unnest(['turnout', 'candidate_share', 'blank', 'null_unmarked']) AS m)""")
def rate_operands(spark, d):
    """numerator and denominator by metric."""
    n = F.col("n")
    r = b.rates(spark, d).select("unit", F.explode(F.array(*map(F.lit, ("turnout", "candidate_share", "blank", "null_unmarked")))).alias("metric"), n.alias("ballots"), (n + 10).alias("registered"), F.col("y").alias("votes"), (n - 2).alias("valid"), F.lit(1).alias("blank"), F.lit(2).alias("null_unmarked"))
    return r.select("unit", "metric", text.numerator(F.col("metric")).cast("long").alias("numerator"), text.denominator(F.col("metric")).cast("long").alias("denominator"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not_an_object' WHEN event_id % 4 = 0 THEN 'extended' WHEN event_id % 3 = 0 THEN 'incomplete' ELSE 'expected' END AS class, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'a;z' ELSE '' END AS unknown,
  CASE WHEN event_id % 5 <> 0 AND (event_id % 4 = 0 OR event_id % 3 <> 0) THEN CASE WHEN event_id % 4 = 0 THEN '1' ELSE json_extract_string(props, '$.k') END END AS k, CASE WHEN event_id % 5 <> 0 THEN event_id % 4 = 0 OR event_id % 3 <> 0 END AS has_k FROM events""")
def payload_classes(spark, d):
    """Classes of raw payloads by their keys, unknown keys, values with missing-key detection."""
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, "[1]").when(i % 4 == 0, '{"z": 2, "k": 1, "a": null}').when(i % 3 == 0, "{}").otherwise(F.col("props"))
    e = b.table(spark, d, "events").select("event_id", raw.alias("raw"))
    value, there = text.map_value(F.from_json(F.when(F.col("raw") != "[1]", F.col("raw")), "map<string,string>"), "k")
    return e.select("event_id", text.payload_class(F.col("raw"), ["k"], ["k"]).alias("class"), F.array_join(text.unknown_keys(F.col("raw"), ["k"]), ";").alias("unknown"), value.alias("k"), there.alias("has_k"))
