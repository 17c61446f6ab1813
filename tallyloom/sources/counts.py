"""Readers of count files and documents. Schemas are fixed; bad rows go to a quarantine table, never away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text

# Header of the count CSV and the bound of a vote count.
HEADER = ("DEP", "DEPNOMBRE", "MUN", "MUNNOMBRE", "ZONA", "PUESTO", "PUESNOMBRE", "MESA", "CORCODIGO", "CORNOMBRE", "CIR", "PAR", "PARNOMBRE", "CAN", "CANNOMBRE", "VOTOS")
MOST_VOTES = 10_000


def read_counts(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a ";" separated count file with an exact header.

    Codes are padded strings; PUESTO may hold letters; votes lie in 0 .. 10 000. A quarantined row keeps its text fields
    and its first reason. A file with another header fails.
    """
    found = spark.read.option("sep", ";").option("encoding", encoding).option("header", True).csv(path).columns
    if tuple(found) != HEADER:
        raise ValueError(f"unexpected header: {found}")
    schema = ", ".join(f"{c} string" for c in HEADER)
    raw = spark.read.schema(schema).option("sep", ";").option("encoding", encoding).option("header", True).option("enforceSchema", False).csv(path)
    return split_counts(raw)


def split_counts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for rows already read as text."""
    codes = {c: text.code(F.col(c), w) for c, w in (("DEP", 2), ("MUN", 3), ("ZONA", 2), ("MESA", 6))}
    votes = F.when(F.trim("VOTOS").rlike("^[0-9]{1,9}$"), F.trim("VOTOS").cast("int"))
    reason = F.lit(None).cast("string")
    for c, v in reversed(codes.items()):
        reason = F.when(v.isNull(), f"bad_code_{c}").otherwise(reason)
    for c in ("DEPNOMBRE", "MUNNOMBRE", "CANNOMBRE"):
        reason = F.when(text.clean(F.col(c)).isNull(), f"empty_{c}").otherwise(reason)
    reason = F.when(votes.isNull(), "bad_votes").when(votes > MOST_VOTES, "votes_out_of_bounds").otherwise(reason)
    marked = raw.withColumn("reason", reason)
    good = marked.where("reason is null").select(
        codes["DEP"].alias("dep"), text.clean(F.col("DEPNOMBRE")).alias("dep_name"), codes["MUN"].alias("mun"), text.clean(F.col("MUNNOMBRE")).alias("mun_name"),
        codes["ZONA"].alias("zone"), F.lpad(F.trim("PUESTO"), 2, "0").alias("place"), text.clean(F.col("PUESNOMBRE")).alias("place_name"), codes["MESA"].alias("unit"),
        F.trim("CORCODIGO").alias("corporation"), F.trim("CIR").alias("circumscription"), F.trim("PAR").alias("party"), text.clean(F.col("PARNOMBRE")).alias("party_name"),
        F.trim("CAN").alias("category"), text.clean(F.col("CANNOMBRE")).alias("category_name"), votes.alias("votes"),
    )
    return good, marked.where("reason is not null")


def with_dialect(raw: DataFrame, columns: dict[str, str | None], labels: dict[str, tuple[str, str]]) -> DataFrame:
    """Another dialect's columns under the fixed names; missing labels become official-<kind>-code-<code>.

    columns: fixed name -> source column, None where the dialect has none; labels: label -> (kind, code column).
    """
    out = raw.select(*[(F.col(src).cast("string") if src else F.lit(None).cast("string")).alias(c) for c, src in columns.items()])
    for label, (kind, code) in labels.items():
        out = out.withColumn(label, F.coalesce(text.clean(F.col(label)), text.placeholder(kind, F.col(code))))
    return out


CANDIDATES, METRICS = "array<struct<code: string, votes: string>>", "array<struct<metric: string, party: string, candidate: string, text: string>>"
COUNT_DOCUMENT = "totals map<string,string>, parties array<struct<code: string, votes: string, candidates: array<struct<code: string, votes: string>>>>"


def count_documents(docs: DataFrame, raw: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(long metric rows, quarantine) of raw JSON count documents: totals and party x candidate arrays.

    Rows: keys, metric, party, candidate, value, status. A document that does not parse is quarantined whole; a value of
    no known form has no status and is quarantined alone.
    """
    none = F.lit(None).cast("string")
    row = lambda metric, party, candidate, said: F.struct(metric.alias("metric"), party.alias("party"), candidate.alias("candidate"), said.alias("text"))
    of_party = lambda p: F.concat(F.array(row(F.lit("party"), p["code"], none, p["votes"])), F.transform(F.coalesce(p["candidates"], F.array().cast(CANDIDATES)), lambda c: row(F.lit("candidate"), p["code"], c["code"], c["votes"])))
    totals = lambda d: F.transform(F.map_entries(d["totals"]), lambda e: row(e["key"], none, none, e["value"]))
    parties = lambda d: F.coalesce(F.flatten(F.transform(d["parties"], of_party)), F.array().cast(METRICS))
    # the document is bound by a transform of one element: parsed once, whatever reads it
    lines = F.transform(F.array(F.from_json(raw, COUNT_DOCUMENT)), lambda d: F.when(d["totals"].isNotNull(), F.concat(totals(d), parties(d))))[0]
    rows = docs.select(*keys, F.explode(lines).alias("__r")).select(*keys, "__r.*").withColumn("status", text.value_state(F.col("text")))
    rows = rows.withColumn("value", F.when(F.col("status") == "observed", text.localized_integer(F.col("text"))))
    bad = docs.where(F.from_json(raw, COUNT_DOCUMENT)["totals"].isNull()).select(*keys, F.lit("document").alias("metric"), F.col(raw).alias("text"), F.lit("not_a_count_document").alias("reason"))
    odd = rows.where("status is null").select(*keys, "metric", "text", F.lit("unreadable_value").alias("reason"))
    return rows.where("status is not null").drop("text"), bad.unionByName(odd)


def scoped_documents(rows: DataFrame, plan: DataFrame, keys: list[str], scope: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose scope is the planned one, those whose scope differs or is unplanned)."""
    j = rows.join(plan.select(*keys, F.col(scope).alias("__want")), keys, "left")
    ok = F.col(scope).eqNullSafe(F.col("__want")) & F.col("__want").isNotNull()
    return j.where(ok).drop("__want"), j.where(~ok).withColumn("reason", F.when(F.col("__want").isNull(), "unplanned").otherwise("scope_mismatch")).drop("__want")


GEOGRAPHY_DOCUMENT = "nodes array<struct<id: string, level: string, name: string, parents: array<string>, children: array<string>>>"


def geography_document(docs: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, findings) of indexed geography documents: both directions of references must agree, one root only."""
    n = docs.select(F.explode(F.from_json(raw, GEOGRAPHY_DOCUMENT)["nodes"]).alias("n")).select("n.*")
    up = n.select(F.explode("parents").alias("parent"), F.col("id").alias("child"))
    down = n.select(F.col("id").alias("parent"), F.explode("children").alias("child"))
    one_way = up.exceptAll(down).withColumn("finding", F.lit("missing_child_reference")).unionAll(down.exceptAll(up).withColumn("finding", F.lit("missing_parent_reference")))
    unknown = up.join(n.select(F.col("id").alias("parent")), "parent", "left_anti").select("parent", "child", F.lit("unknown_parent").alias("finding"))
    roots = n.where(F.size(F.coalesce("parents", F.array().cast("array<string>"))) == 0).select(F.col("id").alias("parent"), F.lit(None).cast("string").alias("child"))
    extra = roots.withColumn("__r", F.expr("row_number() over (order by parent)")).where("__r > 1").select("parent", "child", F.lit("second_root").alias("finding"))  # roots are few
    return n, one_way.unionByName(unknown).unionByName(extra)


def unit_list(docs: DataFrame, raw: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(distinct unit URLs of a place document's array, findings: foreign prefixes and repeats)."""
    u = docs.select(F.explode(F.from_json(raw, "mapagan array<struct<url: string>>")["mapagan"]).alias("m")).select(F.col("m.url").alias("url"))
    n = u.groupBy("url").count()
    found = F.when(~F.col("url").startswith(prefix), "foreign_prefix").when(F.col("count") > 1, "repeated")
    return n.where(F.col("url").startswith(prefix)).select("url"), n.withColumn("finding", found).where("finding is not null").select("url", "finding")


def index_plan(docs: DataFrame, raw: str, base_url: str) -> tuple[DataFrame, DataFrame]:
    """(plan of prefix, file, url from index objects, paths that stand for several prefixes)."""
    e = docs.select(F.explode(F.from_json(raw, "map<string,string>")).alias("prefix", "file")).distinct()
    p = e.withColumn("url", F.concat(F.lit(base_url.rstrip("/") + "/"), "prefix", F.lit("/"), "file"))
    bad = e.groupBy("file").agg(F.count("*").alias("prefixes")).where("prefixes > 1")
    return p, bad


def declared_urls(docs: DataFrame, raw: str) -> DataFrame:
    """Distinct URLs written anywhere in documents."""
    return docs.select(F.explode(text.urls(F.col(raw))).alias("url")).distinct()


def census(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Census rows of a JSON array: one array a file, or one a line (files that can be split)."""
    return spark.read.schema("COD_DEPTO string, DEPARTAMENTO string, COD_MUN string, MUNICIPIO string, MUJERES long, HOMBRES long, TOTAL long, MESAS long, PUESTOS long").option("multiLine", multi_line).json(path)


def catalog_features(spark: SparkSession, path: str, attributes: str, multi_line: bool = True) -> DataFrame:
    """Attributes of feature collections: one a file, or one a line."""
    return spark.read.schema(f"features array<struct<attributes: struct<{attributes}>>>").option("multiLine", multi_line).json(path).select(F.explode("features").alias("f")).select("f.attributes.*")


def roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members with a state, counts by state, members listed more than once) of member<TAB>state lines."""
    r = spark.read.schema("member string, state string").option("sep", "\t").csv(path)
    return r.distinct(), r.groupBy("state").count(), r.groupBy("member").count().where("count > 1")


def shred_release(docs: DataFrame) -> dict[str, DataFrame]:
    """Four tables of release documents (release_id, geographies, mesas, results): geographies, units, facts, categories."""
    r = docs.select("release_id", F.explode("results").alias("r"))
    return {
        "geographies": docs.select("release_id", F.explode("geographies").alias("g")).select("release_id", "g.*"),
        "units": docs.select("release_id", F.explode("mesas").alias("m")).select("release_id", "m.*"),
        "facts": r.select("release_id", F.col("r.*")).drop("candidates"),
        "categories": r.select("release_id", F.col("r.id").alias("fact_id"), F.explode("r.candidates").alias("c")).select("release_id", "fact_id", F.col("c.candidate_id").alias("category_key"), F.col("c.votes.value").alias("votes"), F.col("c.votes.status").alias("status")),
    }


def shred_findings(tables: dict[str, DataFrame]) -> DataFrame:
    """Facts without a geography or unit, categories without a fact."""
    g = tables["geographies"].select("release_id", F.col("id").alias("geography_id"))
    m = tables["units"].select("release_id", F.col("id").alias("mesa_id"))
    f = tables["facts"]
    no_geo = f.join(g, ["release_id", "geography_id"], "left_anti").select("release_id", "id", F.lit("unknown_geography").alias("finding"))
    no_unit = f.where("mesa_id is not null").join(m, ["release_id", "mesa_id"], "left_anti").select("release_id", "id", F.lit("unknown_unit").alias("finding"))
    no_fact = tables["categories"].join(f.select("release_id", F.col("id").alias("fact_id")), ["release_id", "fact_id"], "left_anti").select("release_id", F.col("fact_id").alias("id"), F.lit("category_without_fact").alias("finding"))
    return no_geo.unionByName(no_unit).unionByName(no_fact)


def analysis_bundle(docs: DataFrame) -> dict[str, DataFrame]:
    """Artifact, anomaly, component and report rows of analysis bundles (bundle_id and four arrays of structs)."""
    one = lambda name: docs.select("bundle_id", F.explode(name).alias("x")).select("bundle_id", "x.*")
    out = {n: one(n) for n in ("artifacts", "anomalies", "reports")}
    out["components"] = docs.select("bundle_id", F.explode("anomalies").alias("a")).select("bundle_id", F.col("a.anomaly_id"), F.explode("a.components").alias("component"))
    return out


def changed_sources(now: DataFrame, last: DataFrame, key: str, content: str) -> DataFrame:
    """Source roots against their stored snapshots: new, changed, unchanged or gone."""
    j = now.select(key, F.col(content).alias("now")).join(last.select(key, F.col(content).alias("last")), key, "full_outer")
    state = F.when(F.col("last").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("last"), "unchanged").otherwise("changed")
    return j.select(key, state.alias("state"))


def stateful_csv(df: DataFrame, metrics: list[str]) -> list[Column]:
    """Columns of a flat download: each metric's value and status, text guarded against formulas."""
    kinds = dict(df.dtypes)
    cols = []
    for c in df.columns:
        if c in metrics:
            cols += [F.col(f"{c}.value").alias(c), F.col(f"{c}.status").alias(f"{c}_status")]
        else:
            cols.append(text.csv_safe(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c))
    return cols


def wide_download(facts: DataFrame, id_: list[str], candidate: str, votes: str, candidates: list[str]) -> DataFrame:
    """One column candidate_<id>_votes for each candidate."""
    return facts.groupBy(*id_).agg(*[F.max(F.when(F.col(candidate) == c, F.col(votes))).alias(f"candidate_{c}_votes") for c in candidates])
