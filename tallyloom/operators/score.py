"""Scores for human review and sensitivity of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import stats
from tallyloom.functions.text import tier
from tallyloom.operators import windows


def evidence_points(evidence: DataFrame) -> DataFrame:
    """Adds points to evidence (kind, edits, document_points): statistics add none."""
    kind, edits = F.col("kind"), F.coalesce("edits", F.lit(0))
    points = (
        F.when(kind.isin("accounting_failure", "conflict"), 100).when((kind == "difference") & (edits >= 5), 70).when((kind == "difference") & (edits >= 1), 45)
        .when((kind == "document_review") & (edits >= 2), 70).when((kind == "document_review") & (edits >= 1), 45).when(kind == "coverage", 25).otherwise(0)
    )
    return evidence.withColumn("points", points)


def audit_priority(units: DataFrame, evidence: DataFrame, unit: str) -> DataFrame:
    """Every unit with its score (the largest of its points, not their sum), tier and the kinds behind it."""
    g = evidence_points(evidence).groupBy(unit).agg(F.max("points").alias("__s"), F.array_sort(F.collect_set(F.when(F.col("points") > 0, F.col("kind")))).alias("kinds"))
    out = units.select(unit).distinct().join(g, unit, "left")
    score = F.coalesce("__s", F.lit(0))
    return out.select(unit, score.alias("score"), tier(score).alias("tier"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def outcome_sensitivity(totals: DataFrame, shifts: DataFrame, issues: DataFrame, keys: list[str], candidate: str, votes: str) -> DataFrame:
    """Whether verified and unresolved shifts could change the leader.

    shifts: keys, affected, shift (null: twice the affected votes; never more), verified. issues: keys, issue; an
    outcome with issues is not evaluable. A change needs a shift above the margin, a tie one of exactly the margin.
    """
    two = windows.top_two(totals, keys, candidate, votes)
    most = 2 * F.col("affected")
    s = shifts.withColumn("__s", F.least(F.coalesce(F.col("shift"), most), most)).groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("verified"), F.col("__s"))), F.lit(0)).alias("verified_shift"), F.coalesce(F.sum(F.when(~F.col("verified"), F.col("__s"))), F.lit(0)).alias("unresolved_shift"))
    i = issues.groupBy(*keys).agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    out = two.join(s, keys, "left").join(i, keys, "left").na.fill(0, ["verified_shift", "unresolved_shift"])
    m, v, u = F.col("margin"), F.col("verified_shift"), F.col("verified_shift") + F.col("unresolved_shift")
    status = (
        F.when(F.col("issues").isNotNull(), "not_evaluable").when(v > m, "lead_change_verified").when(u > m, "lead_change_with_unresolved")
        .when(v >= m, "tie_verified").when(u >= m, "tie_with_unresolved").otherwise("robust")
    )
    return out.withColumn("status", status)


def detection_scoring(flagged: DataFrame, injected: DataFrame, keys: list[str], run: str, stratum: str) -> DataFrame:
    """By run: true, false and missed detections, false discovery share, power with exact 95 % bounds."""
    f = flagged.select(run, *keys).distinct().withColumn("__f", F.lit(True))
    i = injected.select(run, *keys, stratum).distinct().withColumn("__i", F.lit(True))
    j = i.join(f, [run, *keys], "full_outer")
    tp, fp, fn = F.count_if(F.col("__f") & F.col("__i")), F.count_if(F.col("__f") & F.col("__i").isNull()), F.count_if(F.col("__i") & F.col("__f").isNull())
    g = j.groupBy(run).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    n = F.col("tp") + F.col("fn")
    out = g.withColumn("fdp", F.coalesce(F.col("fp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))).withColumn("power", F.col("tp") / F.nullif(n, F.lit(0)))
    return out.withColumn("__b", stats.binomial_bounds(F.col("tp"), n)).select("*", F.col("__b.low").alias("power_low"), F.col("__b.high").alias("power_high")).drop("__b")


def power_by_stratum(flagged: DataFrame, injected: DataFrame, keys: list[str], run: str, stratum: str) -> DataFrame:
    f = flagged.select(run, *keys).distinct().withColumn("__f", F.lit(1))
    j = injected.select(run, *keys, stratum).distinct().join(f, [run, *keys], "left")
    return j.groupBy(stratum).agg(F.count("*").alias("injected"), F.count("__f").alias("found")).withColumn("power", F.round(F.col("found") / F.col("injected"), 9))
