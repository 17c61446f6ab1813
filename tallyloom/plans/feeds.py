"""Queries on sources and streams: tables re-read through this library's readers and streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyloom.functions import text
from tallyloom.plans import base as b
from tallyloom.plans.base import query
from tallyloom.scratch import kept
from tallyloom.sources import counts, tables
from tallyloom.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster shares files: the checkpoint folder, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _count_rows(spark, d) -> DataFrame:
    """Facts in the columns of the count file."""
    f = b.facts(spark, d)
    s = lambda c: F.col(c).cast("string")
    return f.select(
        s("department").alias("DEP"), F.concat(F.lit("Dept "), s("department")).alias("DEPNOMBRE"), s("municipality").alias("MUN"), F.concat(F.lit("Mun "), s("municipality")).alias("MUNNOMBRE"),
        F.lit("1").alias("ZONA"), (F.col("place") % 90).cast("string").alias("PUESTO"), F.concat(F.lit("Place "), s("place")).alias("PUESNOMBRE"), (F.col("unit") % 1000000).cast("string").alias("MESA"),
        F.lit("7").alias("CORCODIGO"), F.lit("body").alias("CORNOMBRE"), F.lit("0").alias("CIR"), F.lit("1").alias("PAR"), F.lit("p").alias("PARNOMBRE"), F.col("category").alias("CAN"), F.col("category").alias("CANNOMBRE"),
        F.when(F.col("unit") % 101 == 0, "x").when(F.col("unit") % 103 == 0, "20000").otherwise(s("votes")).alias("VOTOS"),
    )


@query("""SELECT lpad(department::VARCHAR, 2, '0') AS dep, coalesce(reason, 'ok') AS state, count(*) AS rows, coalesce(sum(CASE WHEN reason IS NULL THEN votes END), 0)::BIGINT AS votes
FROM (SELECT *, CASE WHEN unit % 101 = 0 THEN 'bad_votes' WHEN unit % 103 = 0 THEN 'votes_out_of_bounds' END AS reason FROM facts) GROUP BY ALL""")
def count_files(spark, d):
    """Counts written as a Latin-1 file, read back strictly; bad rows go to quarantine."""
    path = _folder(spark, "counts")
    _count_rows(spark, d).select(*counts.HEADER).write.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).csv(path)
    good, bad = counts.read_counts(spark, path)
    rows = good.select("dep", F.lit("ok").alias("state"), "votes").unionByName(bad.select(F.lpad("DEP", 2, "0").alias("dep"), F.col("reason").alias("state"), F.lit(None).cast("int").alias("votes")))
    return rows.groupBy("dep", "state").agg(F.count("*").alias("rows"), F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"))


@query("""SELECT unit, metric, candidate, status, value FROM (
SELECT unit, 'total' AS metric, NULL AS candidate, CASE WHEN unit % 7 = 0 THEN 'unknown' ELSE 'observed' END AS status, CASE WHEN unit % 7 <> 0 THEN sum(votes)::BIGINT END AS value FROM facts GROUP BY unit
UNION ALL SELECT unit, 'party', NULL, 'observed', sum(votes)::BIGINT FROM facts GROUP BY unit UNION ALL SELECT unit, 'candidate', category, 'observed', votes FROM facts)""")
def count_documents(spark, d):
    """Raw JSON count documents as long stateful rows."""
    f = b.facts(spark, d)
    cands = F.array_sort(F.collect_list(F.struct(F.col("category").alias("code"), F.col("votes").cast("string").alias("votes"))))
    g = f.groupBy("unit").agg(F.sum("votes").alias("t"), cands.alias("candidates"))
    total = F.when(F.col("unit") % 7 == 0, "pendiente").otherwise(F.col("t").cast("string"))
    raw = F.to_json(F.struct(F.create_map(F.lit("total"), total).alias("totals"), F.array(F.struct(F.lit("p").alias("code"), F.col("t").cast("string").alias("votes"), "candidates")).alias("parties")))
    rows, _ = counts.count_documents(g.select("unit", raw.alias("raw")), "raw", ["unit"])
    return rows.select("unit", "metric", "candidate", "status", "value")


@query("""SELECT finding, count(*) AS n FROM (SELECT 'missing_child_reference' AS finding FROM units WHERE unit % 10 = 0 UNION ALL SELECT unnest(['missing_child_reference', 'unknown_parent']) FROM (SELECT DISTINCT place FROM units)) GROUP BY finding""")
def geography_documents(spark, d):
    """Places and units as documents with references both ways, one in ten missing below, and the root."""
    u = b.units(spark, d)
    node = lambda id_, level, parents, children: F.struct(id_.alias("id"), F.lit(level).alias("level"), id_.alias("name"), parents.alias("parents"), children.alias("children"))
    none = F.array().cast("array<string>")
    unit_nodes = u.select("place", node(F.concat(F.lit("u"), F.col("unit").cast("string")), "unit", F.array(F.concat(F.lit("p"), F.col("place").cast("string"))), none).alias("n"))
    places = u.groupBy("place").agg(F.collect_list(F.when(F.col("unit") % 10 != 0, F.concat(F.lit("u"), F.col("unit").cast("string")))).alias("c"))
    place_nodes = places.select("place", node(F.concat(F.lit("p"), F.col("place").cast("string")), "place", F.array(F.lit("root")), F.col("c")).alias("n"))
    docs = unit_nodes.unionByName(place_nodes).groupBy("place").agg(F.to_json(F.struct(F.collect_list("n").alias("nodes"))).alias("raw"))
    _, found = counts.geography_document(docs.select("raw"), "raw")
    return found.groupBy("finding").agg(F.count("*").alias("n"))


@query("SELECT department, count(*) AS facts, sum(v)::BIGINT AS votes, sum(k)::BIGINT AS categories FROM (SELECT department, unit, sum(votes) AS v, count(*) AS k FROM facts GROUP BY ALL) GROUP BY department")
def release_documents(spark, d):
    """Release documents shredded to tables, loaded by release, read as one store."""
    f = b.facts(spark, d)
    cand = F.array_sort(F.collect_list(F.struct(F.col("category").alias("candidate_id"), F.struct(F.col("votes").alias("value"), F.lit("observed").alias("status")).alias("votes"))))
    per = f.groupBy("department", "place", "unit").agg(F.sum("votes").alias("v"), cand.alias("candidates"))
    s = lambda c: F.col(c).cast("string")
    result = F.struct(s("unit").alias("id"), s("place").alias("geography_id"), s("unit").alias("mesa_id"), F.col("v").alias("valid_votes"), "candidates")
    docs = per.groupBy(F.concat(F.lit("r"), s("department")).alias("release_id"), "place").agg(
        F.collect_list(result).alias("results"), F.collect_list(F.struct(s("unit").alias("id"))).alias("mesas"), F.array(F.struct(s("place").alias("id"))).alias("geographies")
    )
    shred = counts.shred_release(kept(docs.drop("place"), "documents"))  # read once for each table and check
    folder = _folder(spark, "release")
    tables.load_release({k: shred[k] for k in ("facts", "categories")}, folder, ["release_id"])
    facts = tables.federated(spark, [f"{folder}/facts"])
    cats = tables.federated(spark, [f"{folder}/categories"]).groupBy("release_id").agg(F.count("*").alias("categories"))
    bad = counts.shred_findings(shred).groupBy("release_id").agg(F.count("*").alias("bad"))
    out = facts.groupBy("release_id").agg(F.count("*").alias("facts"), F.sum("valid_votes").alias("votes")).join(cats, "release_id").join(bad, "release_id", "left").where("bad is null")
    return out.select(F.substring("release_id", 2, 9).cast("long").alias("department"), "facts", "votes", "categories")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def sorted_tables(spark, d):
    """Canonical Parquet in key order, opened with its exact columns, one level read."""
    path = _folder(spark, "sorted")
    cols = ["l_returnflag", "l_orderkey", "l_linenumber", "l_quantity"]
    tables.write_sorted(b.table(spark, d, "lineitem").select(*cols), path, ["l_returnflag", "l_orderkey", "l_linenumber"])
    tables.open_table(spark, path, cols)
    return tables.at_level(spark, path, "R", ["l_orderkey", "l_linenumber", "l_quantity"], "l_returnflag")


@query("""WITH m AS (SELECT sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || '}') AS h FROM lineitem), p AS (SELECT substr(sha256(h), 1, 2) AS b, count(*) AS k, sha256(string_agg(h, ';' ORDER BY h)) AS x FROM m GROUP BY ALL)
SELECT sum(k)::BIGINT AS rows, sha256(string_agg(b || '=' || x, ';' ORDER BY b)) AS digest FROM p""")
def exports(spark, d):
    """Export with rows, schema and digest."""
    return tables.export(b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), _folder(spark, "export"), "json").select("rows", "digest")


@query("""SELECT unit, max(CASE WHEN category = 'AF' THEN votes END) AS "candidate_AF_votes", max(CASE WHEN category = 'RF' THEN votes END) AS "candidate_RF_votes" FROM facts GROUP BY unit""")
def wide_downloads(spark, d):
    """S18."""
    return counts.wide_download(b.facts(spark, d), ["unit"], "category", "votes", ["AF", "RF"])


@query("""WITH a AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_id % 3 <> 0 GROUP BY 1), z AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT coalesce(a.user_id, z.user_id) AS user_id, CASE WHEN z.m IS NULL THEN 'new' WHEN a.m IS NULL THEN 'gone' WHEN a.m = z.m THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN z USING (user_id)""")
def changed_sources(spark, d):
    """S23."""
    e = b.table(spark, d, "events")
    last = lambda c: e.where(c).groupBy("user_id").agg(F.max("event_id").alias("content"))
    return counts.changed_sources(last("event_id % 3 <> 0"), last("event_id % 2 = 0"), "user_id", "content")


@query("SELECT o_orderkey AS unit, CASE WHEN regexp_matches(o_orderpriority, '^[=+@\\t\\r-]') THEN '''' || o_orderpriority ELSE o_orderpriority END AS priority FROM orders")
def safe_csv(spark, d):
    """Text guarded against formulas."""
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), text.csv_safe(F.col("o_orderpriority")).alias("priority"))


def _in_two_runs(spark, d, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """The events as a stream whose job runs twice: on the earlier half, then again on its checkpoint with the later half."""
    e, path = b.table(spark, d, "events"), _folder(spark, "events")
    half = e.agg(F.percentile_approx("ts", 0.5)).first()[0]
    later = F.coalesce(F.col("ts") > F.lit(half), F.lit(False))
    for run in (~later, later):
        e.where(run).write.mode("append").parquet(path)
        start(spark.readStream.schema(e.schema).parquet(path)).awaitTermination()


@query("""WITH s AS (SELECT user_id AS key, ts, event_id, event_type AS c FROM events), n AS (SELECT *, c IS DISTINCT FROM lag(c) OVER w OR row_number() OVER w = 1 AS new FROM s WINDOW w AS (PARTITION BY key ORDER BY ts, c))
SELECT key, count(*) AS versions FROM n WHERE new GROUP BY key""")
def stream_versions(spark, d):
    """Versioned snapshots by keyed state over a stream."""
    out, cp = _folder(spark, "versions"), _folder(spark, "cp")

    def start(events: DataFrame) -> StreamingQuery:
        e = events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("content"))
        return jobs.versioned_snapshots(e).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()

    _in_two_runs(spark, d, start)
    return spark.read.parquet(out).groupBy(F.col("key").cast("long").alias("key")).agg(F.count("*").alias("versions"))


@query("""WITH s AS (SELECT user_id AS key, ts, event_type AS c FROM events WHERE ts <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 30 MINUTE),
n AS (SELECT *, c IS DISTINCT FROM lag(c) OVER w OR row_number() OVER w = 1 AS new FROM s WINDOW w AS (PARTITION BY key ORDER BY ts, c))
SELECT key, epoch_us(ts) AS at_us, c AS content, row_number() OVER (PARTITION BY key ORDER BY ts, c) AS version FROM n WHERE new""")
def stream_versions_late(spark, d):
    """R1 with rows out of order: the second run brings rows up to 20 minutes older than what the first has seen."""
    out, cp, path = _folder(spark, "ordered"), _folder(spark, "cp"), _folder(spark, "events")
    e = b.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("content"), "event_id")
    half = e.agg(F.percentile_approx("at", 0.5)).first()[0]
    late = F.coalesce(F.col("at") + F.expr("make_interval(0, 0, 0, 0, 0, 10 * (event_id % 3))") > F.lit(half), F.lit(False))
    for run in (~late, late):
        e.where(run).drop("event_id").write.mode("append").parquet(path)
        jobs.start_ordered(spark.readStream.schema("key string, at timestamp, content string").parquet(path), "30 minutes", out, cp).awaitTermination()
    return spark.read.parquet(out).select(F.col("key").cast("long").alias("key"), F.unix_micros("at").alias("at_us"), "content", "version")


def _ledger(spark, d) -> str:
    """Where the events' ledger is kept; failures stand beside it."""
    out, cp = _folder(spark, "ledger"), _folder(spark, "cp")
    columns = ["user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value"]
    _in_two_runs(spark, d, lambda e: jobs.upsert_latest(e.select(*columns), out, ["user_id"], ["ts", "event_id"], cp, F.col("value") < 10, f"{out}-bad"))
    return out


@query("SELECT user_id, event_id, event_type FROM events WHERE value >= 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upserts(spark, d):
    """R2: latest row of each key by foreachBatch, the second run folded into the first one's table."""
    return jobs.upserted(spark, _ledger(spark, d)).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, value FROM events WHERE value < 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_quarantine(spark, d):
    """Latest failure of each key."""
    return jobs.upserted(spark, _ledger(spark, d) + "-bad").select("user_id", "event_id", "value")


@query("SELECT event_type, user_id % 3 AS status, count(*) AS count FROM events GROUP BY ALL")
def stream_coverage(spark, d):
    """Running counts, the last state of a complete-mode stream."""
    name, cp = f"coverage_{uuid.uuid4().hex}", _folder(spark, "cp")

    def start(events: DataFrame) -> StreamingQuery:
        counted = jobs.running_coverage(events.withColumn("status", F.col("user_id") % 3), "event_type", "status")
        return counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", cp).trigger(availableNow=True).start()

    _in_two_runs(spark, d, start)
    return spark.table(name)


@query("SELECT event_type AS state, count(DISTINCT user_id) AS members FROM events GROUP BY ALL")
def rosters(spark, d):
    """Member and state lines written as a file, read back as a roster with counts by state."""
    path = _folder(spark, "roster")
    b.table(spark, d, "events").select(F.col("user_id").cast("string"), "event_type").distinct().write.option("sep", "\t").csv(path)
    _, states, _ = counts.roster(spark, path)
    return states.withColumnRenamed("count", "members")
