"""Data-quality gates. Each gives findings; a release passes if the union of findings is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.digest import row_hash, set_digest
from tallyloom.schema import Metric


def elector_bounds(facts: DataFrame, voters: Metric, registered: Metric, id_: list[str]) -> DataFrame:
    """Facts with more voters than registered, where both are published."""
    return facts.where(voters.observed() & registered.observed() & (F.col(voters.value) > F.col(registered.value))).select(*id_, F.lit("voters_exceed_registered").alias("finding"))


def value_states(facts: DataFrame, metrics: list[Metric], id_: list[str]) -> DataFrame:
    """Metrics whose value and state disagree."""
    bad = F.array_compact(F.array(*[F.when(~m.valid(), F.lit(m.value)) for m in metrics]))
    return facts.select(*id_, F.explode(bad).alias("metric")).withColumn("finding", F.lit("invalid_state"))


def fact_layers(facts: DataFrame, sources: DataFrame, source: str, id_: list[str], legal: dict[str, str]) -> DataFrame:
    """Facts against their source: unknown source, type or status mismatch, wrong legal status, inferred, ambiguous, duplicate.

    facts and sources have source_type and legal_status; legal fixes the legal status of each source type.
    """
    s = sources.select(source, F.col("source_type").alias("__t"), F.col("legal_status").alias("__l"), F.lit(True).alias("__s"))
    law = F.create_map(*[F.lit(x) for kv in legal.items() for x in kv])
    j = facts.join(s, source, "left")
    found = {
        "unknown_source": F.col("__s").isNull(), "source_type_mismatch": F.col("__t") != F.col("source_type"), "legal_status_mismatch": F.col("__l") != F.col("legal_status"),
        "illegal_status": ~law[F.col("source_type")].eqNullSafe(F.col("legal_status")), "inferred": F.col("inferred"), "ambiguous": F.col("ambiguous"),
    }
    g = j.groupBy(source, *id_).agg(F.count("*").alias("__n"), *[F.bool_or(c).alias(f"__{k}") for k, c in found.items()])
    said = F.array_compact(F.array(*[F.when(F.col(f"__{k}"), k) for k in found], F.when(F.col("__n") > 1, "duplicate")))
    return g.select(source, *id_, F.explode(said).alias("finding"))


def result_arithmetic(facts: DataFrame, candidates: str, blank: str, null: str, unmarked: str, valid: str, voters: str, id_: list[str]) -> DataFrame:
    """Valid votes are candidates and blanks; voters are valid, null and unmarked: findings where all operands are there."""
    ok1 = F.col(candidates) + F.col(blank) == F.col(valid)
    ok2 = F.col(valid) + F.col(null) + F.col(unmarked) == F.col(voters)
    found = F.array_compact(F.array(F.when(~ok1, "valid_votes"), F.when(~ok2, "voters")))  # null operands give null, no finding
    return facts.select(*id_, F.explode(found).alias("finding"))


def complete_vector(candidates: Column, blank: Column, valid: Column, null: Column, unmarked: Column, voters: Column) -> Column:
    """Both accounting identities hold on observed values; candidates: array of votes, none null."""
    whole = F.forall(candidates, lambda v: v.isNotNull())
    total = F.aggregate(candidates, F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))
    return F.coalesce(whole & (total + blank == valid) & (valid + null + unmarked == voters), F.lit(False))


def semantic_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def conflicting_names(rows: DataFrame, code: list[str], name: str) -> DataFrame:
    """Codes with more than one name."""
    return rows.groupBy(*code).agg(F.countDistinct(name).alias("names")).where("names > 1")


def manifests(docs: DataFrame) -> DataFrame:
    """Findings on release manifests: release_id, sources[], datasets[], coverage struct, flags.

    Hashes, zoned timestamps, https URLs, row counts and the coverage identity are checked.
    """
    c = F.col("coverage")
    agrees = text.coverage_ok(c["expected"], c["retrieved"], c["parsed"], c["missing"], c["ambiguous"], c["excluded"])
    top = docs.select("release_id", F.explode(F.array_compact(F.array(F.when(F.size("sources") < 1, "no_sources"), F.when(F.size("datasets") < 1, "no_datasets"), F.when(~agrees, "coverage_identity")))).alias("finding"))
    s = docs.select("release_id", F.explode("sources").alias("s")).select("release_id", F.explode(F.array_compact(F.array(
        F.when(~text.is_sha256(F.col("s.content_hash")), "source_hash"), F.when(text.zoned_timestamp(F.col("s.retrieved_at")).isNull(), "source_timestamp"), F.when(~F.coalesce(F.col("s.url").startswith("https://"), F.lit(False)), "source_url"),
    ))).alias("finding"))
    d = docs.select("release_id", F.explode("datasets").alias("d")).select("release_id", F.explode(F.array_compact(F.array(F.when(~text.is_sha256(F.col("d.sha256")), "dataset_hash"), F.when(F.coalesce(F.col("d.rows"), F.lit(-1)) < 0, "dataset_rows")))).alias("finding"))
    return top.unionByName(s).unionByName(d)


def provenance_constant(rows: DataFrame, by: str, provenance: list[str], sources: DataFrame) -> DataFrame:
    """Groups with more than one provenance, or one that is not a known source's."""
    p = rows.select(by, *provenance).distinct()
    known = p.join(sources.select(*provenance).distinct().withColumn("__k", F.lit(True)), provenance, "left")
    g = known.groupBy(by).agg(F.count("*").alias("provenances"), F.count_if(F.col("__k").isNull()).alias("unknown"))
    return g.where("provenances > 1 or unknown > 0")


def contextual_rows(rows: DataFrame, grain: str, analytic: list[str], id_: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows for analysis, findings: contextual rows marked as evidence)."""
    ok = F.col(grain).isin(analytic)
    return rows.where(ok), rows.where(~ok).select(*id_, F.lit("contextual_row").alias("finding"))


def anomalies(units: DataFrame, facts: DataFrame, unit: str, complete: str) -> DataFrame:
    """Deterministic anomalies: units without a result and units whose ballot vector does not add up."""
    missing = units.join(facts.select(unit), unit, "left_anti").select(unit, F.lit("missing_result").alias("anomaly"))
    broken = facts.where(~F.col(complete)).select(unit, F.lit("inconsistent_ballot_vector").alias("anomaly"))
    return missing.unionByName(broken)


def pinned_totals(rows: DataFrame, key: list[str], value: str, kind: str, pins: DataFrame) -> DataFrame:
    """Totals of a source against pinned ones (check, expected): check, expected, actual, status.

    Checks: rows, sum, repeated_keys and kind:<k> for each kind; a check that either side lacks differs.
    """
    repeated = rows.groupBy(*key).count().agg(F.sum(F.col("count") - 1).alias("repeated_keys"))
    whole = rows.agg(F.count("*").alias("rows"), F.sum(value).alias("sum")).crossJoin(repeated)  # one row each
    long = whole.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("rows", "sum", "repeated_keys"))), F.array(*[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("rows", "sum", "repeated_keys")]))).alias("check", "actual"))
    kinds = rows.groupBy(F.concat(F.lit("kind:"), F.col(kind).cast("string")).alias("check")).agg(F.count("*").alias("actual"))
    j = long.unionByName(kinds).join(pins.select("check", F.col("expected").cast("long").alias("expected")), "check", "full_outer")
    return j.select("check", "expected", "actual", F.when(F.col("expected").eqNullSafe(F.col("actual")), "equal").otherwise("different").alias("status"))


def verify(gates: dict[str, DataFrame]) -> DataFrame:
    """Every gate with its number of findings, whether it passes, and an order-independent digest of its findings.

    The digest of no findings is that of the empty text.
    """
    each = []
    for name, df in gates.items():
        rows = df.select(F.lit(name).alias("gate"), row_hash(df.columns).alias("h"))
        none = df.sparkSession.createDataFrame([(name,)], "gate string")
        each.append(none.join(set_digest(rows, ["gate"], "h"), "gate", "left"))
    found = reduce(DataFrame.unionByName, each).select("gate", F.coalesce("members", F.lit(0)).cast("long").alias("findings"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"))
    return found.withColumn("passes", F.col("findings") == 0)


def relation_findings(geographies: DataFrame, units: DataFrame, facts: DataFrame, categories: DataFrame, scope: list[str], unit_level: str) -> DataFrame:
    """Broken references of a loaded release, one row each: scope, record, id, finding.

    geographies: id, level, parent_id; units: id; facts: id, geography_id, geography_level, unit_id; categories: fact_id;
    all with the scope's columns. A fact's place must exist and have the fact's level; facts of unit_level, and only those,
    name a unit, which must exist. A record may have several findings. A null id refers to nothing.
    """
    g = geographies.select(*scope, F.col("id").alias("geography_id"), F.col("level").alias("__level")).distinct()
    u = units.select(*scope, F.col("id").alias("unit_id"), F.lit(True).alias("__unit")).distinct()
    named, placed = F.col("unit_id").isNotNull(), F.col("__level").isNotNull()
    found = F.array(
        F.when(~placed, "unknown_geography"), F.when(placed & ~F.col("geography_level").eqNullSafe(F.col("__level")), "wrong_level"),
        F.when(placed & ((F.col("__level") == unit_level) != named), F.when(named, "unit_above_its_level").otherwise("no_unit")), F.when(named & F.col("__unit").isNull(), "unknown_unit"),
    )
    j = facts.join(g, [*scope, "geography_id"], "left").join(u, [*scope, "unit_id"], "left")
    bad = j.select(*scope, F.lit("fact").alias("record"), "id", F.explode(F.array_compact(found)).alias("finding"))
    no_fact = categories.join(facts.select(*scope, F.col("id").alias("fact_id")), [*scope, "fact_id"], "left_anti")
    no_parent = geographies.where("parent_id is not null").join(g.withColumnRenamed("geography_id", "parent_id"), [*scope, "parent_id"], "left_anti")
    bad = bad.unionByName(no_fact.select(*scope, F.lit("category").alias("record"), F.col("fact_id").alias("id"), F.lit("no_fact").alias("finding")))
    return bad.unionByName(no_parent.select(*scope, F.lit("geography").alias("record"), "id", F.lit("orphan").alias("finding")))
