"""Matching places between tables by exact codes and labels; several candidates are never chosen among."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text


def label_crosswalk(left: DataFrame, right: DataFrame, left_label: str, right_label: str) -> DataFrame:
    """left label -> right label by tiers: unique exact label, else unique prefix either way, else unique token subset.

    Labels are distinct and few (departments). Prefixes join on the first word and subsets on any shared word, so no
    label meets all others. A tier with more than one candidate gives none.
    """
    a = left.select(F.col(left_label).alias("l")).distinct().withColumn("ln", text.exact_label(F.col("l")))
    b = right.select(F.col(right_label).alias("r")).distinct().withColumn("rn", text.exact_label(F.col("r")))
    aw, bw = a.withColumn("w", F.explode(F.array_distinct(F.split("ln", " ")))), b.withColumn("w", F.explode(F.array_distinct(F.split("rn", " "))))
    pairs = aw.join(bw, "w").select("l", "ln", "r", "rn").distinct()
    subset = (F.size(F.array_except(F.split("ln", " "), F.split("rn", " "))) == 0) | (F.size(F.array_except(F.split("rn", " "), F.split("ln", " "))) == 0)
    level = F.when(F.col("ln") == F.col("rn"), 1).when(F.col("rn").startswith(F.col("ln")) | F.col("ln").startswith(F.col("rn")), 2).when(subset, 3)
    found = pairs.withColumn("tier", level).where("tier is not null")
    best = found.groupBy("l", "tier").agg(F.count("*").alias("n"), F.min("r").alias("r")).withColumn("first", F.min("tier").over(Window.partitionBy("l")))
    one = best.where("tier = first and n = 1").select("l", "r", F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("tokens")), F.col("tier")).alias("basis"))
    return a.select("l").join(one, "l", "left").select(F.col("l").alias(left_label), F.col("r").alias(right_label), F.coalesce("basis", F.lit("none")).alias("basis"))


def apply_aliases(df: DataFrame, aliases: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(df with labels replaced by reviewed aliases (keys, label, target), findings: aliases that are not one-to-one)."""
    twice = lambda by: aliases.groupBy(*keys, by).count().where("count > 1").select(*keys, F.col(by).alias("label"), F.lit(f"repeated_{by}").alias("finding"))
    findings = twice(label).unionByName(twice("target"))
    good = aliases.dropDuplicates([*keys, label, "target"]).join(findings.where(f"finding = 'repeated_{label}'").select(*keys, F.col("label").alias(label)), [*keys, label], "left_anti")
    out = df.join(good.select(*keys, label, "target"), [*keys, label], "left")
    return out.withColumn("used_alias", F.col("target").isNotNull()).withColumn("matched_label", F.coalesce("target", label)).drop("target"), findings


def census_join(census: DataFrame, population: DataFrame, department: str, label: str, value_a: str, value_b: str, outside: Column) -> DataFrame:
    """Full outer join on department and normalised label with a status; the ratio only for matches."""
    key = [department, "norm"]
    side = lambda df, v, n: df.withColumn("norm", text.exact_label(F.col(label))).groupBy(*key).agg(F.count("*").alias(f"n_{n}"), F.min(v).alias(v))
    j = side(census, value_a, "a").join(side(population, value_b, "b"), key, "full_outer")
    status = (
        F.when(outside, "extraterritorial").when(F.col("n_a") > 1, "duplicate_census").when(F.col("n_b") > 1, "duplicate_population")
        .when(F.col("n_a").isNull(), "missing_census").when(F.col("n_b").isNull(), "missing_population").otherwise("exact")
    )
    matched = F.col("status") == "exact"
    out = j.withColumn("status", status)
    return out.select(*key, "status", F.when(matched, F.col(value_a) / F.nullif(F.col(value_b), F.lit(0))).alias("ratio"))


def year_crosswalk(old: DataFrame, new: DataFrame, code: str, label: str, outside: Column) -> DataFrame:
    """One row for each code of two years: extraterritorial, ambiguous, unmatched (three bases) or high.

    Ambiguous: a code without exactly one label in a year, or a label of several codes of a year.
    """

    def side(df: DataFrame, n: str) -> DataFrame:
        pairs = df.select(code, F.col(label).alias("raw"), text.exact_label(F.col(label)).alias("norm")).distinct()
        pairs = pairs.withColumn("codes", F.size(F.collect_set(code).over(Window.partitionBy("norm"))))
        return pairs.groupBy(code).agg(F.countDistinct("norm").alias(f"labels_{n}"), F.max("codes").alias(f"codes_{n}"), F.min("norm").alias(f"norm_{n}"), F.min("raw").alias(f"label_{n}"))

    j = side(old, "old").join(side(new, "new"), code, "full_outer")
    many = lambda n: (F.col(f"labels_{n}") != 1) | (F.col(f"codes_{n}") > 1)
    made_up = text.is_placeholder(F.col("label_old")) | text.is_placeholder(F.col("label_new"))
    status = (
        F.when(outside, "extraterritorial").when(F.coalesce(many("old"), F.lit(False)) | F.coalesce(many("new"), F.lit(False)), "ambiguous")
        .when(F.col("labels_old").isNull() | F.col("labels_new").isNull(), "unmatched_absent").when(made_up, "unmatched_placeholder")
        .when(F.col("norm_old") != F.col("norm_new"), "unmatched_label").otherwise("high")
    )
    return j.select(code, "label_old", "label_new", status.alias("status"))


def changes(crosswalk: DataFrame, old: DataFrame, new: DataFrame, code: str, values: list[str]) -> DataFrame:
    """Null-safe changes of values between matched years: a null on a side gives a null change."""
    a = old.select(code, *[F.col(v).alias(f"{v}_old") for v in values])
    b = new.select(code, *[F.col(v).alias(f"{v}_new") for v in values])
    out = crosswalk.where("status = 'high'").select(code).join(a, code).join(b, code)
    return out.select("*", *[text.delta(F.col(f"{v}_old"), F.col(f"{v}_new")).alias(f"{v}_change") for v in values])


def release_comparison(left: DataFrame, right: DataFrame, geo: DataFrame, categories: DataFrame, value: str) -> DataFrame:
    """Two releases (place, category, value) through crosswalks (left_x, right_x, approved); a reason where there is no pair."""
    j = left.select("place", "category", F.col(value).alias("left_value"))
    j = j.join(geo.select(F.col("left_place").alias("place"), "right_place", F.col("approved").alias("__g")), "place", "left")
    j = j.join(categories.select(F.col("left_category").alias("category"), "right_category", F.col("approved").alias("__c")), "category", "left")
    r = right.select(F.col("place").alias("right_place"), F.col("category").alias("right_category"), F.col(value).alias("right_value"))
    j = j.join(r, ["right_place", "right_category"], "left")
    reason = (
        F.when(F.col("right_place").isNull(), "no_place_crosswalk").when(~F.col("__g"), "place_not_approved").when(F.col("right_category").isNull(), "no_category_crosswalk")
        .when(~F.col("__c"), "category_not_approved").when(F.col("right_value").isNull(), "not_published")
    )
    ok = reason.isNull()
    return j.select("place", "category", "left_value", F.when(ok, F.col("right_value")).alias("right_value"), F.when(ok, F.col("right_value") - F.col("left_value")).alias("change"), reason.alias("reason"))
