"""Descriptions of results: concentration, digits, margins, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import stable
from tallyloom.operators.trees import running
from tallyloom.scratch import kept


def composition(facts: DataFrame, keys: list[str], category: str, value: str, candidates: Column) -> DataFrame:
    """Concentration of the candidates' positive totals: top shares, HHI, effective number, normalised entropy.

    Groups without positive candidate votes keep their row with nulls.
    """
    t = facts.groupBy(*keys, category).agg(F.sum(value).alias("__sum"), F.bool_or(candidates).alias("__is"))
    w = Window.partitionBy(*keys)
    t = t.withColumn("__v", F.when(F.col("__is") & (F.col("__sum") > 0), F.col("__sum")))
    t = t.withColumn("__s", F.col("__v") / F.sum("__v").over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc_nulls_last("__s"), category)))
    s = F.col("__s")
    g = t.groupBy(*keys).agg(
        F.sum("__v").alias("candidate_votes"), F.count("__v").cast("long").alias("categories"), F.max(F.when(F.col("__n") == 1, s)).alias("top1"),
        F.sum(F.when(F.col("__n") <= 2, s)).alias("top2"), F.sum(s * s).alias("hhi"), F.sum(-s * F.log(s)).alias("__h"),
    )
    entropy = F.when(F.col("categories") > 1, F.col("__h") / F.log(F.col("categories").cast("double"))).when(F.col("categories") == 1, F.lit(0.0))
    return g.select(*keys, "candidate_votes", "categories", stable(F.col("top1")).alias("top1"), stable(F.col("top2")).alias("top2"), stable(F.col("hhi")).alias("hhi"), stable(1 / F.col("hhi")).alias("effective_number"), stable(entropy).alias("entropy"))


def special_categories(facts: DataFrame, keys: list[str], category: str, value: str, special: dict[str, str]) -> DataFrame:
    """For each special code: present, votes (null when absent), share of all votes."""
    aggs = [F.sum(value).alias("__all")]
    for name, code in special.items():
        hit = F.col(category) == code
        aggs += [F.bool_or(hit).alias(f"{name}_present"), F.sum(F.when(hit, F.col(value))).alias(f"{name}_votes")]
    out = facts.groupBy(*keys).agg(*aggs)
    return out.select("*", *[stable(F.col(f"{n}_votes") / F.nullif(F.col("__all"), F.lit(0))).alias(f"{n}_share") for n in special]).drop("__all")


def last_digits(facts: DataFrame, category: str, value: str, floor: int) -> DataFrame:
    """Last-digit chi-square against uniform (9 degrees) by category and pooled ("*"), of values from floor up."""
    d = facts.where(F.col(value) >= floor).select(category, (F.col(value) % 10).cast("int").alias("d"))
    counts = d.groupBy(F.col(category).cast("string").alias(category), "d").agg(F.count("*").alias("o"))
    pooled = counts.groupBy("d").agg(F.sum("o").alias("o")).select(F.lit("*").alias(category), "d", "o")
    g = counts.unionByName(pooled).groupBy(category).agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o")).alias("__oo"), F.count("*").alias("__k"), F.max("o").alias("__max"), F.min("o").alias("__min"))
    e = F.col("n") / 10.0
    least = F.when(F.col("__k") < 10, F.lit(0)).otherwise(F.col("__min"))
    chi = F.col("__oo") / e - F.col("n")
    deviation = 100 * F.greatest(F.col("__max") / F.col("n") - 0.1, 0.1 - least / F.col("n"))
    return g.select(category, "n", F.round(chi, 9).alias("chi_square"), F.round(deviation, 9).alias("max_deviation_points"))


def unanimous(facts: DataFrame, unit: str, value: str) -> DataFrame:
    """One row: units, units without votes, unanimous units and their share of those with votes."""
    u = facts.groupBy(unit).agg(F.max(value).alias("m"), F.sum(value).alias("s"))
    out = u.agg(F.count("*").alias("units"), F.count_if(F.coalesce(F.col("s"), F.lit(0)) == 0).alias("zero_total"), F.count_if((F.col("s") > 0) & (F.col("m") == F.col("s"))).alias("unanimous"))
    return out.withColumn("share", F.round(F.col("unanimous") / F.nullif(F.col("units") - F.col("zero_total"), F.lit(0)), 9))


def densify(facts: DataFrame, unit: str, category: str, codes: list[str], value: str, universe: DataFrame) -> DataFrame:
    """One vector for each unit of the universe: a column for each code, absence read as zero, and how many were there."""
    wide = facts.groupBy(unit).agg(*[F.sum(F.when(F.col(category) == c, F.col(value))).alias(c) for c in codes])
    rows = universe.select(unit).distinct().join(wide, unit, "left")
    present = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in codes), F.lit(0))
    return rows.select(unit, present.alias("present"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in codes])


def margins(facts: DataFrame, place: str, category: str, value: str, first: str, second: str) -> DataFrame:
    """Margin between two candidates by place: winner, signed margin, share of the place's votes, part of the whole margin."""
    pick = lambda c: F.coalesce(F.sum(F.when(F.col(category) == c, F.col(value))), F.lit(0))
    p = facts.groupBy(place).agg(F.sum(value).alias("votes"), pick(first).alias("first_votes"), pick(second).alias("second_votes"))
    whole = p.agg(F.sum(F.col("first_votes") - F.col("second_votes")).alias("__w"))
    m = F.col("first_votes") - F.col("second_votes")
    out = p.crossJoin(F.broadcast(whole))  # one row
    winner = F.when(m > 0, first).when(m < 0, second).otherwise("tie")
    return out.select(place, "votes", "first_votes", "second_votes", winner.alias("winner"), m.alias("margin"), F.round(m / F.nullif(F.col("votes"), F.lit(0)), 9).alias("margin_share"), F.round(100 * m / F.nullif(F.col("__w"), F.lit(0)), 9).alias("percent_of_margin"))


def quantiles(counts: DataFrame, by: list[str], value: str, n: str, points: list[float]) -> DataFrame:
    """by, and for each point q<i> the value at that share of a group's rows, linear between two of them.

    counts: distinct values without nulls, and how often each stands (n). Values are numbered by ranges of (by, value), so no
    task holds a group; of each group only the rows around a point are picked.
    """
    upto = kept(running(counts, by, [value], F.col(n), "__upto"), "quantiles")
    size = upto.groupBy(*by).agg(F.max("__upto").alias("__all"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    j = upto.join(size.withColumnsRenamed({c: f"__{c}" for c in by}), reduce(Column.__and__, same))
    first, last, out = F.col("__upto") - F.col(n), F.col("__upto") - 1, []
    for i, p in enumerate(points):
        at = F.lit(float(p)) * (F.col("__all") - 1)
        low, high = F.floor(at), F.ceil(at)
        pick = lambda k: F.max(F.when((first <= k) & (k <= last), F.col(value)))
        out.append((pick(low), pick(high), F.max(at - low)))
    g = j.groupBy(*by).agg(*[c.alias(f"__{k}{i}") for i, three in enumerate(out) for k, c in zip("lhf", three, strict=True)])
    between = lambda i: F.when(F.col(f"__f{i}") == 0, F.col(f"__l{i}")).otherwise((1 - F.col(f"__f{i}")) * F.col(f"__l{i}") + F.col(f"__f{i}") * F.col(f"__h{i}"))
    return g.select(*by, *[between(i).alias(f"q{i}") for i in range(len(points))])


def join_summary(joined: DataFrame, ratio: str, by: list[str], thresholds: list[float]) -> DataFrame:
    """Counts by status group with the ratio's min, median, 95 % point (linear), max and counts above thresholds.

    Rows are counted by distinct ratio first; what follows reads those counts.
    """
    counts = kept(joined.groupBy(*by, F.col(ratio).cast("double").alias("__r")).agg(F.count("*").alias("__n")), "ratios")
    there, r = F.col("__r").isNotNull(), F.col("__r")
    above = [F.coalesce(F.sum(F.when(r > t, F.col("__n"))), F.lit(0)).alias(f"above_{str(t).replace('.', '_')}") for t in thresholds]
    g = counts.groupBy(*by).agg(F.sum("__n").alias("rows"), F.coalesce(F.sum(F.when(there, F.col("__n"))), F.lit(0)).alias("with_ratio"), F.round(F.min("__r"), 9).alias("min_ratio"), F.round(F.max("__r"), 9).alias("max_ratio"), *above)
    q = quantiles(counts.where(there), by, "__r", "__n", [0.5, 0.95]).withColumnsRenamed({c: f"__{c}" for c in by})
    j = g.join(q, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), "left")
    return j.select(*by, "rows", "with_ratio", "min_ratio", F.round("q0", 9).alias("median_ratio"), F.round("q1", 9).alias("p95_ratio"), "max_ratio", *[f"above_{str(t).replace('.', '_')}" for t in thresholds])


def variant_summaries(variants: dict[str, DataFrame], ratio: str, by: list[str], thresholds: list[float]) -> DataFrame:
    """`join_summary` of the same join under several mappings, side by side with the variant's name."""
    parts = [df.select(F.lit(name).alias("variant"), *by, ratio) for name, df in variants.items()]
    return join_summary(reduce(DataFrame.unionByName, parts), ratio, ["variant", *by], thresholds)


def matched_coverage(crosswalk: DataFrame, observations: DataFrame, code: str, value: str) -> DataFrame:
    """By status: places, their share, total of value and its share."""
    v = observations.groupBy(code).agg(F.sum(value).alias("v"))
    g = crosswalk.join(v, code, "left").groupBy("status").agg(F.count("*").alias("places"), F.coalesce(F.sum("v"), F.lit(0)).alias("total"))
    w = Window.partitionBy()  # one row for each status
    return g.select("status", "places", "total", F.round(F.col("places") / F.sum("places").over(w), 9).alias("places_share"), F.round(F.col("total") / F.nullif(F.sum("total").over(w), F.lit(0)), 9).alias("total_share"))


def coverage_counters(ledger: DataFrame, plan: str, network: str, parse: str, expected: DataFrame) -> DataFrame:
    """Expected, retrieved, parsed, missing, ambiguous, excluded by plan, and whether they agree."""
    n = lambda c: F.count_if(c)
    g = ledger.groupBy(plan).agg(
        n(F.col(network) == "retrieved").alias("retrieved"), n(F.col(parse) == "parsed").alias("parsed"),
        n(F.col(parse) == "ambiguous").alias("ambiguous"), n(F.col(network) == "excluded").alias("excluded"),
    )
    out = expected.join(g, plan, "left").na.fill(0, ["retrieved", "parsed", "ambiguous", "excluded"])
    out = out.withColumn("missing", F.col("expected") - F.col("retrieved") - F.col("excluded"))
    return out.withColumn("agrees", (F.col("missing") >= 0) & (F.col("parsed") + F.col("ambiguous") <= F.col("retrieved")))


def candidate_summary(facts: DataFrame, keys: list[str], category: str, value: str, slate: DataFrame, valid: Column) -> DataFrame:
    """Total and share of the valid votes of each candidate on the slate; absent candidates have no value."""
    t = facts.where(valid).groupBy(*keys, category).agg(F.sum(value).alias("votes"))
    t = t.withColumn("valid_votes", F.sum("votes").over(Window.partitionBy(*keys)))
    return slate.join(t, category, "left").select(*keys, *slate.columns, "votes", "valid_votes", F.round(F.col("votes") / F.nullif(F.col("valid_votes"), F.lit(0)), 9).alias("share"))


def digit_comparison(facts: DataFrame, year: str, unit: str, category: str, value: str, floor: int) -> DataFrame:
    """By year: pooled last-digit chi-square and share of unanimous units."""
    d = facts.where(F.col(value) >= floor).groupBy(year, (F.col(value) % 10).alias("d")).agg(F.count("*").alias("o"))
    chi = d.groupBy(year).agg(F.sum("o").alias("digits"), (F.sum(F.col("o") * F.col("o")) * 10 / F.sum("o") - F.sum("o")).alias("chi_square"))
    u = facts.groupBy(year, unit).agg(F.max(value).alias("m"), F.sum(value).alias("s")).groupBy(year).agg(F.count("*").alias("units"), F.count_if((F.col("s") > 0) & (F.col("m") == F.col("s"))).alias("unanimous"))
    return u.join(chi, year, "left").withColumn("chi_square", F.round("chi_square", 9))


def descriptive(rows: DataFrame, unit: str, department: str, family: str, status: str, candidate: str, votes: str, statuses: list[str]) -> DataFrame:
    """The descriptive summary of long metric rows, as one long table: section, department, family, status, candidate, value, share.

    Sections: units (how many distinct ones), status (rows of each family by the status of their denominator, zeros
    included), candidate (totals, with shares of all), department_candidate (totals), margin (first less second, ties by
    name; null with fewer than two). candidate is null in rows that are of no candidate; null votes count for nothing, and a
    candidate without any has no total. No rows give units 0 only.

    All sections are sums over one aggregation by department, family and candidate. A unit counts in its first row, found
    where rows of a unit stand together, so no task or table holds a row for each unit: rows dealt by unit are not shuffled
    again and decide how many tasks there are; rows of no unit are dealt by what they hold.
    """
    own = F.when(F.col(candidate).isNotNull(), F.col(votes))
    renamed = rows.select(*[F.col(c).alias(n) for c, n in ((unit, "u"), (department, "d"), (family, "f"), (candidate, "c"))], F.col(status).alias("s"), own.alias("v"))
    alone = F.when(F.col("u").isNull(), F.xxhash64(*"dfcsv"))
    first = F.row_number().over(Window.partitionBy("u", "__alone").orderBy("u")) == 1
    marked = renamed.withColumn("__alone", alone).withColumn("__first", F.col("u").isNotNull() & first)
    counts = [F.count_if(F.col("s") == s).alias(f"n{i}") for i, s in enumerate(statuses)]
    g = kept(marked.groupBy("d", "f", "c").agg(*counts, F.sum("v").alias("v"), F.count_if("__first").alias("units")), "summary")
    none = lambda n: F.lit(None).cast("string").alias(n)
    text = lambda c, n: F.col(c).cast("string").alias(n)
    noshare = F.lit(None).cast("double").alias("share")
    units = g.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("value")).select(F.lit("units").alias("section"), none("department"), none("family"), none("status"), none("candidate"), "value", noshare)
    families = g.where("f is not null").groupBy("f").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(statuses))])
    each = F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"n{i}").alias("value")) for i, s in enumerate(statuses)])
    status_rows = families.select(F.lit("status").alias("section"), none("department"), text("f", "family"), F.explode(each).alias("x")).select("section", "department", "family", "x.status", none("candidate"), "x.value", noshare)
    total = lambda *by: g.where("c is not null").groupBy(*by).agg(F.sum("v").cast("long").alias("value")).where("value is not null")
    totals = total("c").select(text("c", "candidate"), "value")
    whole = totals.agg(F.sum("value").alias("all"))  # one row
    shares = totals.crossJoin(F.broadcast(whole)).select(F.lit("candidate").alias("section"), none("department"), none("family"), none("status"), "candidate", "value", (F.col("value") / F.nullif(F.col("all"), F.lit(0))).alias("share"))
    by_department = total("d", "c").select(F.lit("department_candidate").alias("section"), text("d", "department"), none("family"), none("status"), text("c", "candidate"), "value", noshare)
    top = totals.orderBy(F.desc("value"), "candidate").limit(2)
    margin = top.agg(F.when(F.count("*") == 2, F.max("value") - F.min("value")).alias("value"), F.count("*").alias("n")).where("n > 0").select(F.lit("margin").alias("section"), none("department"), none("family"), none("status"), none("candidate"), "value", noshare)
    return reduce(DataFrame.unionByName, [units, status_rows, shares, by_department, margin])


def universe_coverage(crosswalk: DataFrame, old: DataFrame, new: DataFrame, round_: str, code: str, outside: Column) -> DataFrame:
    """Per round: observed and domestic places of both years, crosswalk rows by status, matched shares of both domestic universes.

    crosswalk: round, code, status (as `crosswalk.year_crosswalk`); old, new: the places observed (round, code); outside: which
    of them are extraterritorial. unmatched counts all its bases; a share over no places is null.
    """
    side = lambda df, n: df.select(round_, code, outside.alias("o")).distinct().groupBy(round_).agg(F.countDistinct(code).alias(f"observed_{n}"), F.count_distinct(F.when(~F.col("o"), F.col(code))).alias(f"domestic_{n}"))
    kinds = {"high": F.col("status") == "high", "label_mismatch": F.col("status") == "unmatched_label", "extraterritorial": F.col("status") == "extraterritorial", "unmatched": F.col("status").startswith("unmatched"), "ambiguous": F.col("status") == "ambiguous"}
    walk = crosswalk.groupBy(round_).agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    j = side(old, "old").join(side(new, "new"), round_, "full_outer").join(walk, round_, "full_outer")
    zero = F.lit(0).cast("long")
    j = j.select(round_, *[F.coalesce(c, zero).alias(c) for c in ("observed_old", "observed_new", "domestic_old", "domestic_new", *kinds)])
    share = lambda n: (F.col("high") / F.nullif(F.col(f"domestic_{n}"), F.lit(0))).alias(f"matched_share_{n}")
    return j.select("*", share("old"), share("new"))
