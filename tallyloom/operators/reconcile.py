"""Reconciliation of source layers: arithmetic, completeness, conflicts, comparisons. Layers never mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.scratch import kept


MOST_LAYERS = 1000


def few(layers: DataFrame) -> DataFrame:
    """The distinct source layers, of which there are MOST_LAYERS at most: checked, since every one is set beside every unit."""
    if layers.limit(MOST_LAYERS + 1).count() > MOST_LAYERS:
        raise ValueError(f"more than {MOST_LAYERS} source layers")
    return layers


def identity_conflicts(records: DataFrame, source: str, identity: list[str], content: Column) -> DataFrame:
    """Identities that a source has more than once: duplicate (equal content) or conflict."""
    g = records.groupBy(source, *identity).agg(F.count("*").alias("rows"), F.countDistinct(content).alias("contents"))
    return g.where("rows > 1").withColumn("finding", F.when(F.col("contents") > 1, "conflict").otherwise("duplicate"))


def compare_sources(values: DataFrame, source: str, left: str, right: str, keys: list[str], category: str, value: str) -> DataFrame:
    """Keys that both sources have: signed difference of totals and the least edits between their categories.

    values: long rows (source, keys, category, value). Edits exist only if both have the same categories, all with
    values: the larger of the sums of rises and of falls. Nothing unpublished becomes zero.
    """
    side = lambda s, n: values.where(F.col(source) == s).select(*keys, category, F.col(value).alias(n), F.lit(True).alias(f"in_{n}"))
    both = side(left, "left").join(side(right, "right"), [*keys, category], "full_outer")
    d = F.col("right") - F.col("left")
    same = F.bool_and(F.col("left").isNotNull() & F.col("right").isNotNull())
    out = both.groupBy(*keys).agg(
        F.bool_or("in_left").alias("__l"), F.bool_or("in_right").alias("__r"), same.alias("comparable"),
        F.sum(F.when(d.isNotNull(), d)).alias("difference"), F.sum(F.greatest(d, F.lit(0))).alias("__up"), F.sum(F.greatest(-d, F.lit(0))).alias("__down"),
    )
    return out.where("__l and __r").select(*keys, "comparable", F.when(F.col("comparable"), F.col("difference")).alias("difference"), F.when(F.col("comparable"), F.greatest("__up", "__down")).alias("min_edits"))


def completeness(expected: DataFrame, records: DataFrame, unit: list[str], ambiguous: str) -> DataFrame:
    """Every expected unit: complete, missing, duplicated or ambiguous."""
    got = records.groupBy(*unit).agg(F.count("*").alias("n"), F.bool_or(ambiguous).alias("__amb"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("__amb"), "ambiguous").when(F.col("n") > 1, "duplicated").otherwise("complete")
    return expected.select(*unit).distinct().join(got, unit, "left").select(*unit, state.alias("state"))


def completeness_by_source(expected: DataFrame, records: DataFrame, source: str, unit: list[str], ambiguous: str) -> DataFrame:
    """The same for each source that sent anything, as counts."""
    sources = records.select(source).distinct()
    want = expected.select(*unit).distinct().join(F.broadcast(few(sources)))
    return completeness(want, records, [source, *unit], ambiguous).groupBy(source, "state").count().withColumnRenamed("count", "units")


def identity_universe(expected: DataFrame, records: DataFrame, unit: list[str]) -> DataFrame:
    """One row: identities missing and extra; the gate passes if both are zero."""
    a, b = expected.select(*unit).distinct().withColumn("__e", F.lit(1)), records.select(*unit).distinct().withColumn("__r", F.lit(1))
    j = a.join(b, unit, "full_outer")
    return j.agg(F.count_if(F.col("__r").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("extra")).withColumn("passes", F.expr("missing = 0 and extra = 0"))


def membership_findings(roster: DataFrame, observed: DataFrame, acknowledged: DataFrame, member: str) -> DataFrame:
    """Members with a finding: missing, extra, unacknowledged, overclaimed (acknowledged but not observed), smuggled.

    roster: member, state ("kept" members are expected). smuggled: observed though the roster excludes it.
    """
    j = roster.select(member, "state").join(observed.select(member).distinct().withColumn("__o", F.lit(True)), member, "full_outer")
    j = j.join(acknowledged.select(member).distinct().withColumn("__a", F.lit(True)), member, "full_outer")
    o, a = F.coalesce("__o", F.lit(False)), F.coalesce("__a", F.lit(False))
    finding = (
        F.when(F.col("state").isNull() & o, "extra").when((F.col("state") != "kept") & o, "smuggled").when(a & ~o, "overclaimed")
        .when((F.col("state") == "kept") & ~o, "missing").when(o & ~a, "unacknowledged")
    )
    return j.select(member, finding.alias("finding")).where("finding is not null")


def without_result(units: DataFrame, facts: DataFrame, unit: str) -> DataFrame:
    """Units that have no fact."""
    return units.join(facts.select(unit), unit, "left_anti")


MEMBERS = 1024  # records of a class that one row holds


def overlapping_records(records: DataFrame, id_: str, atoms: str) -> DataFrame:
    """Pairs of records that share an atom, each pair once with the number shared. A null atom is shared with nothing.

    Records with the same atoms are one class. Classes are joined on atoms and their pairs counted; members are put in for
    them last, in lists of MEMBERS, so that pairs of records are made once, unshuffled.
    """
    flat = records.select(F.col(id_).alias("id"), F.explode(atoms).alias("atom")).where("id is not null and atom is not null")
    own = flat.groupBy("id").agg(F.array_sort(F.collect_set("atom")).alias("atoms"))
    dealt = kept(own.withColumn("part", F.floor(F.row_number().over(Window.partitionBy("atoms", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")) / MEMBERS)), "records")
    lists = dealt.groupBy("atoms", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"), "part").agg(F.collect_list("id").alias("ids"))
    lists = kept(lists.withColumn("class", F.sha2(F.to_json("atoms"), 256)).withColumn("list", F.struct("salt", "part")), "lists")
    classes = lists.groupBy("class").agg(F.first("atoms").alias("atoms"))
    tokens = kept(classes.select("class", F.explode("atoms").alias("atom")), "tokens")
    a, b = (tokens.select(F.col("class").alias(c), "atom") for c in ("c", "d"))
    pairs = a.join(b, "atom").where("c <= d").groupBy("c", "d").agg(F.count("*").alias("shared"))
    left, right = (lists.select(F.col("class").alias(c), F.col("list").alias(f"{c}l"), F.col("ids").alias(f"{c}s")) for c in ("c", "d"))
    both = pairs.join(left, "c").join(right, "d").where("c < d or cl <= dl").repartition("cl", "dl", "c", "d")
    made = both.select("shared", (F.col("c").eqNullSafe(F.col("d")) & (F.col("cl") == F.col("dl"))).alias("one"), F.explode("cs").alias("x"), "ds").select("shared", "one", "x", F.explode("ds").alias("y")).where("not one or x < y")
    return made.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def nested_scopes(records: DataFrame, id_: str, path: str) -> DataFrame:
    """Pairs (outer, inner) of records whose scope paths are nested or equal: each inner joins the beginnings of its path."""
    parts = F.split(path, "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inner = records.select(F.col(id_).alias("inner"), F.col(path).alias("inner_path"), F.explode(starts).alias("p"))
    outer = records.select(F.col(id_).alias("outer"), F.col(path).alias("p"))
    return inner.join(outer, "p").where("outer <> inner and (p <> inner_path or outer < inner)").select("outer", "inner")


def _overlaps(records: DataFrame, id_: str, atoms: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, copies; id, atom; id, scope, own): what records are linked by. A null atom or path links nothing."""
    ids = records.groupBy(F.col(id_).alias("id")).agg(F.count("*").alias("copies"))
    shared = records.select(F.col(id_).alias("id"), F.explode(atoms).alias("atom")).where("atom is not null").distinct()
    parts = F.split("own", "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    scopes = records.where(F.col(path).isNotNull()).select(F.col(id_).alias("id"), F.col(path).alias("own")).distinct()
    known = scopes.select(F.col("own").alias("scope")).distinct()
    inside = scopes.select("id", "own", F.explode(starts).alias("scope"))
    return ids, shared, inside.join(known, "scope", "left_semi").select("id", "scope", (F.col("scope") == F.col("own")).alias("own"))


def _pairs(shared: DataFrame, inside: DataFrame) -> DataFrame:
    """a, b, via, token: pairs that hold all overlaps together, linear in the records: each member of a common atom with the
    atom's least id, each record inside a scope with the least id that has just this scope. Both are overlaps themselves."""
    star = shared.groupBy("atom").agg(F.min("id").alias("a")).join(shared, "atom").where("a <> id").select("a", F.col("id").alias("b"), F.lit("atom").alias("via"), F.col("atom").cast("string").alias("token"))
    heads = inside.where("own").groupBy("scope").agg(F.min("id").alias("a"))
    nested = heads.join(inside, "scope").where("a <> id").select("a", F.col("id").alias("b"), F.lit("scope").alias("via"), F.col("scope").alias("token")).distinct()
    return star.unionByName(nested)


def overlap_pairs(records: DataFrame, id_: str, atoms: str, path: str) -> DataFrame:
    """`_pairs` of records."""
    return _pairs(*_overlaps(records, id_, atoms, path)[1:])


def overlap_classes(records: DataFrame, id_: str, atoms: str, path: str) -> DataFrame:
    """One row for each id: class (the least id that overlaps lead to), copies, atom_links, scope_links.

    Records overlap if they have the same id, share an atom, or one's scope path lies in the other's or is the same. copies:
    records of this id. atom_links: other ids that share an atom, counted once for each atom. scope_links: other ids with the
    same scope, one inside it or one around it. Pairs of a common atom or scope are never made: it is counted, and its
    members are linked to its least id.
    """
    from tallyloom.operators import graphs

    ids, shared, inside = (kept(x, "overlaps") for x in _overlaps(records, id_, atoms, path))
    of_atoms = shared.join(shared.groupBy("atom").agg(F.count("*").alias("n")), "atom").groupBy("id").agg(F.sum(F.col("n") - 1).alias("atom_links"))
    sizes = inside.groupBy("scope").agg(F.countDistinct("id").alias("within"), F.count_distinct(F.when(F.col("own"), F.col("id"))).alias("just"))
    of_scopes = inside.join(sizes, "scope").groupBy("id").agg(F.sum(F.when(F.col("own"), F.col("within") - 1).otherwise(F.col("just"))).alias("scope_links"))
    classes = graphs.components(_pairs(shared, inside).select("a", "b"))
    out = ids.join(classes, "id", "left").join(of_atoms, "id", "left").join(of_scopes, "id", "left")
    zero = F.lit(0).cast("long")
    return out.select("id", F.coalesce("class", "id").alias("class"), "copies", F.coalesce("atom_links", zero).alias("atom_links"), F.coalesce("scope_links", zero).alias("scope_links"))


def declared_rollup_errors(declared: DataFrame, computed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Declared rows that a computed rollup lacks or has with another value."""
    c = computed.select(*keys, F.col(value).alias("computed"))
    return declared.join(c, keys, "left").where(~F.col(value).eqNullSafe(F.col("computed"))).select(*keys, F.col(value).alias("declared"), "computed")


def controlling_source(facts: DataFrame, source: str, controlling: str, keys: list[str], value: str) -> DataFrame:
    """Every other source against the controlling one on all keys: only_controlling, only_other or different."""
    control = facts.where(F.col(source) == controlling).select(*keys, F.col(value).alias("controlling"), F.lit(True).alias("__c"))
    other = facts.where(F.col(source) != controlling).select(source, *keys, F.col(value).alias("other"), F.lit(True).alias("__o"))
    names = other.select(source).distinct()
    j = control.join(F.broadcast(few(names))).join(other, [source, *keys], "full_outer")
    finding = F.when(F.col("__o").isNull(), "only_controlling").when(F.col("__c").isNull(), "only_other").when(~F.col("controlling").eqNullSafe(F.col("other")), "different")
    return j.select(source, *keys, "controlling", "other", finding.alias("finding")).where("finding is not null")


def document_index(documents: DataFrame, units: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """(documents (unit, type, url) of known units with an id, those of unknown units)."""
    from tallyloom.functions.digest import tuple_hash

    known = documents.join(units.select(unit).distinct(), unit, "left_semi")
    return known.withColumn("document_id", tuple_hash(F.col(unit), F.col("type"), F.col("url"))), documents.join(units.select(unit), unit, "left_anti")


def arithmetic(records: DataFrame, rules: list[tuple[str, str, list[str], str]], source: str, id_: list[str]) -> DataFrame:
    """Declared rules (source, rule name, addends, total) on records: pass, fail or not_evaluable with the reason."""
    checks = []
    for src, name, addends, total in rules:
        fields = [*addends, total]
        lost = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
        added = sum((F.col(a) for a in addends[1:]), F.col(addends[0]))
        result = F.when(F.size(lost) > 0, "not_evaluable").when(added == F.col(total), "pass").otherwise("fail")
        checks.append(F.when(F.col(source) == src, F.struct(F.lit(name).alias("rule"), result.alias("result"), F.when(F.size(lost) > 0, F.concat(F.lit("missing: "), F.array_join(lost, ","))).alias("reason"))))
    return records.select(source, *id_, F.explode(F.array_compact(F.array(*checks))).alias("c")).select(source, *id_, "c.*")


def revision_class(previous: Column, current: Column, marker: Column, same_source: Column, compatible: Column) -> Column:
    """How one version follows another."""
    return (
        F.when(~compatible, "incompatible").when(~same_source, "cross_source").when(previous.eqNullSafe(current), "unchanged")
        .when(marker, "official_correction").otherwise("unmarked_revision")
    )


def reconcile(expected: DataFrame, records: DataFrame, source: str, unit: str, category: str, value: str, left: str, right: str) -> DataFrame:
    """All checks of two layers as one table of findings: check, source, state, n.

    Each check is a grouping by unit that is counted at once: layers are not joined with each other, nor units with layers.
    A unit is compared as `compare_sources` does it, from the least and largest value of each side's category.
    """
    rows = records.groupBy(F.col(source).alias("source"), F.col(unit).alias("unit")).agg(F.bool_or(F.col(value).isNull()).alias("ambiguous"))
    want = expected.select(F.col(unit).alias("unit")).distinct().withColumn("wanted", F.lit(True))
    seen = rows.join(want, "unit", "left").groupBy("source").agg(*[F.count_if(F.col("wanted") & F.col("source").isNotNull() & (F.col("ambiguous") == x)).alias(n) for n, x in (("complete", False), ("ambiguous", True))])
    each = [F.struct(F.lit(x).alias("state"), F.col(x).alias("n")) for x in ("complete", "ambiguous", "missing")]
    states = few(kept(seen, "layers")).crossJoin(F.broadcast(want.agg(F.count("*").alias("all")))).withColumn("missing", F.col("all") - F.col("complete") - F.col("ambiguous"))
    done = states.select(F.lit("completeness").alias("check"), F.col("source").alias(source), F.explode(F.array(*each)).alias("x")).select("check", source, "x.*").where("n > 0")

    v = F.col(value)
    by = records.groupBy(F.col(source).alias("source"), F.col(unit).alias("unit"), F.col(category).alias("category")).agg(F.count("*").alias("rows"), (F.min(v) < F.max(v)).alias("differ"))
    clash = by.where("rows > 1").groupBy("source", F.when(F.col("differ"), "conflict").otherwise("duplicate").alias("state")).agg(F.count("*").alias("n")).select(F.lit("identity").alias("check"), F.col("source").alias(source), "state", "n")

    side = lambda s, n: [F.count_if(F.col(source) == s).alias(f"{n}_rows"), F.count(F.when(F.col(source) == s, v)).alias(f"{n}_known"), F.min(F.when(F.col(source) == s, v)).alias(f"{n}_min"), F.max(F.when(F.col(source) == s, v)).alias(f"{n}_max")]
    both = records.groupBy(F.col(unit).alias("unit"), F.col(category).alias("category")).agg(*side(left, "left"), *side(right, "right")).where("left_rows + right_rows > 0")
    comparable = F.expr("unit is not null and category is not null and left_rows > 0 and right_rows > 0 and left_rows = left_known and right_rows = right_known")
    equal = F.greatest("left_max", "right_max") - F.least("left_min", "right_min") == 0
    units = both.groupBy("unit").agg(F.max("left_rows").alias("l"), F.max("right_rows").alias("r"), F.bool_and(comparable).alias("comparable"), F.bool_and(equal).alias("equal")).where("l > 0 and r > 0")
    state = F.when(~F.col("comparable"), "not_comparable").when(F.col("equal"), "equal").otherwise("different")
    pair = units.groupBy(state.alias("state")).agg(F.count("*").alias("n")).select(F.lit("comparison").alias("check"), F.lit(f"{left}/{right}").alias(source), "state", "n")
    return done.unionByName(clash).unionByName(pair)


def full(records: DataFrame, expected: DataFrame, declared: DataFrame, source: str, unit: str, place: str, fields: list[str], rules: list[tuple[str, str, list[str], str]], voters: str, registered: str, left: str, right: str) -> DataFrame:
    """Every check of a reconciliation as one table: check, source, key (of the unit or place), field, state.

    records: source, unit, place, values map<string, bigint>, states map<string, string> and `registered`. declared: source,
    place, values (rollups as published). Checks:
    - arithmetic: a source's declared rules (source, name, addends, total): pass, fail, not_evaluable
    - electors: values[voters] within registered: within, exceeds, not_evaluable
    - value_state: observed_without_value, value_without_observation, negative; only what is wrong
    - identity: duplicate (equal content) or conflict, where a source has a unit more than once
    - completeness: each source and expected unit: complete, missing, duplicated, ambiguous; unexpected units
    - comparison of left and right: equal, different, not_comparable (a side lacks the unit, is ambiguous, or no field of
      both has values); fields that only one has do not count
    - rollup: each declared place and field of a source against its units' sum: equal, different, blocked (a unit lacks the
      field, or is ambiguous), no_units
    A record is read once for its own checks, and grouped once by source and unit for the others; layers of a unit stand in
    one map (MOST_LAYERS at most). Nothing is joined with itself.
    """
    value, key = lambda f: F.col("values")[f], F.col(unit).cast("string")
    said = lambda check, field, state: F.struct(F.lit(check).alias("check"), field.alias("field"), state.alias("state"))
    own = []
    for name_of, name, addends, total in rules:
        parts = [value(f) for f in (*addends, total)]
        sum_ = parts[0]
        for x in parts[1:-1]:
            sum_ = sum_ + x
        lost = parts[0].isNull()
        for x in parts[1:]:
            lost = lost | x.isNull()
        state = F.when(lost, "not_evaluable").when(sum_ == parts[-1], "pass").otherwise("fail")
        own.append(F.when(F.col(source) == name_of, said("arithmetic", F.lit(name), state)))
    bound = F.when(value(voters).isNull() | F.col(registered).isNull(), "not_evaluable").when(value(voters) > F.col(registered), "exceeds").otherwise("within")
    own.append(said("electors", F.lit(voters), bound))
    for f in fields:
        seen = F.col("states")[f] == "observed"
        wrong = F.when(seen & value(f).isNull(), "observed_without_value").when(~seen & value(f).isNotNull(), "value_without_observation").when(value(f) < 0, "negative")
        own.append(F.when(wrong.isNotNull(), said("value_state", F.lit(f), wrong)))
    out = records.select(F.explode(F.array_compact(F.array(*own))).alias("c"), F.col(source).alias("source"), key.alias("key")).select("c.check", "source", "key", "c.field", "c.state")

    content = F.xxhash64(*[value(f) for f in fields], *[F.col("states")[f] for f in fields], F.col(registered))
    by = records.groupBy(F.col(source).alias("source"), F.col(unit).alias("unit")).agg(
        F.count("*").alias("n"), (F.min(content) != F.max(content)).alias("clash"), F.min(place).alias("place"), *[F.min_by(value(f), content).alias(f"v{k}") for k, f in enumerate(fields)]
    )
    by = kept(by.select("source", "unit", "place", "n", "clash", F.array(*[F.col(f"v{k}") for k in range(len(fields))]).alias("values")), "layers")  # numbers are grouped by hash, maps by sorting
    none = F.lit(None).cast("string")
    identity = by.where("n > 1").select(F.lit("identity").alias("check"), "source", F.col("unit").cast("string").alias("key"), none.alias("field"), F.when(F.col("clash"), "conflict").otherwise("duplicate").alias("state"))

    layers = sorted(r[0] for r in few(by.select("source").where("source is not null").distinct()).collect())
    units = by.where("source is not null").groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("n", "clash", "values")))).alias("has"))
    j = units.join(expected.select(F.col(unit).alias("unit")).distinct().withColumn("wanted", F.lit(True)), "unit", "full_outer")
    there = lambda s: F.col("has")[s]
    lines = []
    for s in layers:
        state = F.when(there(s).isNull(), "missing").when(there(s)["clash"], "ambiguous").when(there(s)["n"] > 1, "duplicated").otherwise("complete")
        state = F.when(F.col("wanted"), state).when(there(s).isNotNull(), "unexpected")
        lines.append(F.when(state.isNotNull(), F.struct(F.lit("completeness").alias("check"), F.lit(s).alias("source"), state.alias("state"))))
    a, b = there(left), there(right)
    common = F.filter(F.array(*[F.struct(a["values"][k].alias("a"), b["values"][k].alias("b")) for k in range(len(fields))]), lambda f: f["a"].isNotNull() & f["b"].isNotNull())
    same = F.forall(common, lambda f: f["a"] == f["b"])
    apart = a.isNull() | b.isNull() | a["clash"] | b["clash"] | (F.size(common) == 0)
    lines.append(F.when(F.col("has").isNotNull(), F.struct(F.lit("comparison").alias("check"), F.lit(f"{left}/{right}").alias("source"), F.when(F.coalesce(apart, F.lit(True)), "not_comparable").when(same, "equal").otherwise("different").alias("state"))))
    across = j.select(F.col("unit").cast("string").alias("key"), F.explode(F.array_compact(F.array(*lines))).alias("c")).select("c.check", "c.source", "key", none.alias("field"), "c.state")

    sums = [F.when(~F.max("clash") & (F.count(F.col("values")[k]) == F.count("*")), F.sum(F.col("values")[k])).alias(f"sum_{k}") for k in range(len(fields))]
    rolled = by.groupBy("source", "place").agg(*sums, F.count("*").alias("units"))
    d = declared.select(F.col(source).alias("source"), F.col(place).alias("place"), F.col("values").alias("declared")).join(rolled, ["source", "place"], "left")
    each = [F.struct(F.lit(f).alias("field"), F.when(F.col("units").isNull(), "no_units").when(F.col(f"sum_{k}").isNull(), "blocked").when(F.col(f"sum_{k}").eqNullSafe(F.col("declared")[f]), "equal").otherwise("different").alias("state")) for k, f in enumerate(fields)]
    rollup = d.select(F.lit("rollup").alias("check"), "source", F.col("place").cast("string").alias("key"), F.explode(F.array(*each)).alias("c")).select("check", "source", "key", "c.field", "c.state")
    return out.unionByName(identity).unionByName(across).unionByName(rollup)
