"""Queries on source layers, crosswalks and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import digest, text
from tallyloom.operators import crosswalk, quality, read, reconcile, rollup
from tallyloom.plans import base as b
from tallyloom.plans.base import query
from tallyloom.scratch import kept

PAIR = """p AS (SELECT coalesce(l.unit, r.unit) AS unit, l.votes AS lv, r.votes AS rv FROM (SELECT * FROM sources WHERE source = 'a') l FULL JOIN (SELECT * FROM sources WHERE source = 'b') r ON l.unit = r.unit AND l.category = r.category)"""
COMPARED = f"""{PAIR}, c AS (SELECT unit, bool_and(lv IS NOT NULL AND rv IS NOT NULL) AS comparable, sum(rv - lv)::BIGINT AS diff, sum(greatest(rv - lv, 0)) FILTER (WHERE rv - lv IS NOT NULL) AS up, sum(greatest(lv - rv, 0)) FILTER (WHERE rv - lv IS NOT NULL) AS down
FROM p GROUP BY unit HAVING bool_or(lv IS NOT NULL) AND bool_or(rv IS NOT NULL))"""


@query(f"WITH {COMPARED} SELECT unit, comparable, CASE WHEN comparable THEN diff END AS difference, CASE WHEN comparable THEN greatest(up, down)::BIGINT END AS min_edits FROM c")
def source_comparison(spark, d):
    """Two layers on shared keys, with the least edits."""
    return reconcile.compare_sources(b.sources(spark, d), "source", "a", "b", ["unit"], "category", "votes")


@query("""WITH e AS (SELECT DISTINCT unit FROM units), r AS (SELECT source, unit, count(*) AS n, bool_or(category = 'RF' AND unit % 5 = 0) AS amb FROM sources GROUP BY ALL), s AS (SELECT DISTINCT source FROM sources)
SELECT s.source, CASE WHEN n IS NULL THEN 'missing' WHEN amb THEN 'ambiguous' WHEN n > 1 THEN 'duplicated' ELSE 'complete' END AS state, count(*) AS units FROM e CROSS JOIN s LEFT JOIN r ON r.source = s.source AND r.unit = e.unit GROUP BY ALL""")
def completeness(spark, d):
    """Expected units by source."""
    rec = b.sources(spark, d).withColumn("ambiguous", (F.col("category") == "RF") & (F.col("unit") % 5 == 0))
    return reconcile.completeness_by_source(b.units(spark, d), rec, "source", ["unit"], "ambiguous")


@query("""SELECT source, unit, count(*) AS rows, count(DISTINCT votes) AS contents, CASE WHEN count(DISTINCT votes) > 1 THEN 'conflict' ELSE 'duplicate' END AS finding FROM sources GROUP BY source, unit HAVING count(*) > 1""")
def identity_conflicts(spark, d):
    """A9."""
    return reconcile.identity_conflicts(b.sources(spark, d), "source", ["unit"], F.col("votes"))


@query("""SELECT count(*) FILTER (WHERE s.unit IS NULL) AS missing, 0 AS extra, count(*) FILTER (WHERE s.unit IS NULL) = 0 AS passes FROM (SELECT DISTINCT unit FROM units) u LEFT JOIN (SELECT DISTINCT unit FROM sources) s USING (unit)""")
def identity_universe(spark, d):
    """J18."""
    return reconcile.identity_universe(b.units(spark, d), b.sources(spark, d), ["unit"])


@query("""WITH r AS (SELECT c_custkey AS member, CASE WHEN c_custkey % 10 = 0 THEN 'dropped' ELSE 'kept' END AS state FROM customer), o AS (SELECT DISTINCT place AS member FROM units WHERE place % 17 <> 0), a AS (SELECT c_custkey AS member FROM customer WHERE c_custkey % 3 <> 0)
SELECT member, finding FROM (SELECT member, CASE WHEN state <> 'kept' AND o THEN 'smuggled' WHEN a AND NOT o THEN 'overclaimed' WHEN state = 'kept' AND NOT o THEN 'missing' WHEN o AND NOT a THEN 'unacknowledged' END AS finding
FROM (SELECT r.member, r.state, o.member IS NOT NULL AS o, a.member IS NOT NULL AS a FROM r LEFT JOIN o USING (member) LEFT JOIN a USING (member))) WHERE finding IS NOT NULL""")
def membership(spark, d):
    """J19."""
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("member"))
    roster = c.withColumn("state", F.when(F.col("member") % 10 == 0, "dropped").otherwise("kept"))
    return reconcile.membership_findings(roster, b.units(spark, d).where("place % 17 <> 0").select(F.col("place").alias("member")), c.where("member % 3 <> 0"), "member")


@query("SELECT c_custkey AS place FROM customer WHERE c_custkey NOT IN (SELECT place FROM units WHERE place % 7 <> 0)")
def without_result(spark, d):
    """Places without results, of which every seventh lost them."""
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("place"))
    return reconcile.without_result(c, b.units(spark, d).where("place % 7 <> 0"), "place")


@query("""WITH f AS (SELECT source, unit, sum(votes)::BIGINT AS votes FROM sources GROUP BY ALL), c AS (SELECT unit, votes FROM f WHERE source = 'a'), o AS (SELECT unit, votes FROM f WHERE source = 'b')
SELECT 'b' AS source, unit, c.votes AS controlling, o.votes AS other, CASE WHEN o.unit IS NULL OR o.votes IS NULL THEN 'only_controlling' WHEN c.votes IS NULL THEN 'only_other' ELSE 'different' END AS finding FROM c FULL JOIN o USING (unit) WHERE c.votes IS DISTINCT FROM o.votes""")
def controlling_source(spark, d):
    """J24."""
    f = b.sources(spark, d).groupBy("source", "unit").agg(F.sum("votes").alias("votes"))
    return reconcile.controlling_source(f, "source", "a", ["unit"], "votes")


@query("""WITH c AS (SELECT municipality, category, sum(votes)::BIGINT AS v FROM facts GROUP BY ALL) SELECT municipality, category, v + 1 AS declared, v AS computed FROM c WHERE municipality % 4 = 0""")
def declared_rollup(spark, d):
    """J23."""
    c = b.facts(spark, d).groupBy("municipality", "category").agg(F.sum("votes").alias("votes"))
    return reconcile.declared_rollup_errors(c.withColumn("votes", F.col("votes") + (F.col("municipality") % 4 == 0).cast("int")), c, ["municipality", "category"], "votes")


@query(f"""WITH {COMPARED}, t AS (SELECT source, unit, count(*) AS n FROM sources GROUP BY ALL), s AS (SELECT DISTINCT source FROM sources)
SELECT 'completeness' AS check, s.source, CASE WHEN t.n IS NULL THEN 'missing' ELSE 'complete' END AS state, count(*) AS n FROM (SELECT DISTINCT unit FROM units) u CROSS JOIN s LEFT JOIN t ON t.unit = u.unit AND t.source = s.source GROUP BY ALL
UNION ALL SELECT 'comparison', 'a/b', CASE WHEN NOT comparable THEN 'not_comparable' WHEN diff = 0 AND greatest(up, down) = 0 THEN 'equal' ELSE 'different' END, count(*) FROM c GROUP BY ALL""")
def reconciliation(spark, d):
    """All checks of two layers."""
    return reconcile.reconcile(b.units(spark, d), b.sources(spark, d), "source", "unit", "category", "votes", "a", "b")


FIELDS = ["AF", "NF", "NO", "RF", "total"]


def _layers(spark, d) -> DataFrame:
    """Both layers of units as records with values, states and registered electors, with every kind of fault in some."""
    u = b.units(spark, d).select("unit", "place")
    pick = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col("votes"))), F.lit(0)).alias(c) for c in FIELDS[:-1]]
    w = b.sources(spark, d).groupBy("source", "unit").agg(*pick).join(u, "unit")
    k = F.col("unit")
    w = w.where(~((F.col("source") == "b") & (k % 19 == 0))).withColumn("t", F.col("AF") + F.col("NF") + F.col("NO") + F.col("RF"))
    copy = F.when(k % 37 == 0, F.array(F.lit(0), F.lit(1))).when(k % 29 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    w = w.withColumn("more", F.explode(copy)).withColumn("total", F.col("t") + F.col("more") + (k % 31 == 0).cast("int"))
    w = w.withColumn("NO", F.when(~((k % 17 == 0) | (k % 41 == 0)), F.when(k % 47 == 0, -1 - F.col("NO")).otherwise(F.col("NO"))))
    pairs = lambda f: F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*[f(c) for c in FIELDS]))
    state = lambda c: F.when((k % 17 == 0) if c == "NO" else (k % 53 == 0) if c == "RF" else F.lit(False), "unavailable").otherwise("observed")
    return w.select("source", "unit", "place", pairs(lambda c: F.col(c).cast("long")).alias("values"), pairs(state).alias("states"), F.when(k % 59 != 0, F.col("t") + 5 - F.when(k % 23 == 0, 20).otherwise(0)).alias("registered"))


_LAYERS = """w0 AS (SELECT source, unit, coalesce(sum(votes) FILTER (WHERE category = 'AF'), 0)::BIGINT AS af, coalesce(sum(votes) FILTER (WHERE category = 'NF'), 0)::BIGINT AS nf, coalesce(sum(votes) FILTER (WHERE category = 'NO'), 0)::BIGINT AS no0, coalesce(sum(votes) FILTER (WHERE category = 'RF'), 0)::BIGINT AS rf FROM sources GROUP BY ALL),
w AS (SELECT source, w0.unit, place, af, nf, rf, CASE WHEN unit % 17 <> 0 AND unit % 41 <> 0 THEN CASE WHEN unit % 47 = 0 THEN -1 - no0 ELSE no0 END END AS no, af + nf + no0 + rf AS t, more FROM w0 JOIN units USING (unit), unnest(CASE WHEN unit % 37 = 0 THEN [0, 1] WHEN unit % 29 = 0 THEN [0, 0] ELSE [0] END) AS x(more) WHERE NOT (source = 'b' AND unit % 19 = 0)),
r AS (SELECT *, t + more + (unit % 31 = 0)::INT AS total, CASE WHEN unit % 59 <> 0 THEN t + 5 - CASE WHEN unit % 23 = 0 THEN 20 ELSE 0 END END AS registered FROM w),
one AS (SELECT source, unit, min(place) AS place, count(*) AS n, count(*) > 1 AND min(more) <> max(more) AS clash, min(af) AS af, min(nf) AS nf, min(no) AS no, min(rf) AS rf, min(total) AS total FROM r GROUP BY ALL),
wanted AS (SELECT DISTINCT unit FROM units WHERE unit % 43 <> 0),
f AS (SELECT coalesce(a.unit, z.unit) AS unit, a.unit IS NOT NULL AND z.unit IS NOT NULL AND NOT a.clash AND NOT z.clash AS ok, a.af = z.af AND a.nf = z.nf AND a.rf = z.rf AND a.total = z.total AND coalesce(a.no = z.no, true) AS same FROM (SELECT * FROM one WHERE source = 'a') a FULL JOIN (SELECT * FROM one WHERE source = 'b') z USING (unit)),
g AS (SELECT place, bool_or(clash) AS clash, count(*) AS n, count(no) AS m, sum(af) AS af, sum(nf) AS nf, sum(no) AS no, sum(rf) AS rf, sum(total) AS total FROM one WHERE source = 'a' GROUP BY place),
p AS (SELECT place, field, CASE WHEN clash OR field = 'NO' AND n <> m THEN 'blocked' WHEN field = 'total' AND place % 11 = 0 THEN 'different' ELSE 'equal' END AS state FROM g, unnest(['AF', 'NF', 'NO', 'RF', 'total']) AS x(field)),
c AS (SELECT 'arithmetic' AS check, source, 'sum' AS field, CASE WHEN no IS NULL THEN 'not_evaluable' WHEN af + nf + no + rf = total THEN 'pass' ELSE 'fail' END AS state FROM r
UNION ALL SELECT 'electors', source, 'total', CASE WHEN registered IS NULL THEN 'not_evaluable' WHEN total > registered THEN 'exceeds' ELSE 'within' END FROM r
UNION ALL SELECT 'value_state', source, 'NO', CASE WHEN no IS NULL THEN 'observed_without_value' ELSE 'negative' END FROM r WHERE unit % 17 <> 0 AND (no IS NULL OR no < 0)
UNION ALL SELECT 'value_state', source, 'RF', 'value_without_observation' FROM r WHERE unit % 53 = 0
UNION ALL SELECT 'identity', source, NULL, CASE WHEN clash THEN 'conflict' ELSE 'duplicate' END FROM one WHERE n > 1
UNION ALL SELECT 'completeness', s.source, NULL, CASE WHEN o.unit IS NULL THEN 'missing' WHEN o.clash THEN 'ambiguous' WHEN o.n > 1 THEN 'duplicated' ELSE 'complete' END FROM wanted CROSS JOIN (VALUES ('a'), ('b')) s(source) LEFT JOIN one o ON o.unit = wanted.unit AND o.source = s.source
UNION ALL SELECT 'completeness', source, NULL, 'unexpected' FROM one WHERE unit % 43 = 0
UNION ALL SELECT 'comparison', 'a/b', NULL, CASE WHEN NOT ok THEN 'not_comparable' WHEN same THEN 'equal' ELSE 'different' END FROM f
UNION ALL SELECT 'rollup', 'a', field, state FROM p UNION ALL SELECT 'rollup', 'a', field, 'no_units' FROM unnest(['AF', 'NF', 'NO', 'RF', 'total']) AS x(field))"""


@query(f"WITH {_LAYERS} SELECT \"check\", source, field, state, count(*) AS n FROM c GROUP BY ALL")
def full_reconciliation(spark, d):
    """D14 with Q1, Q2, Q3, A3, A9, J14, J17, J23: every check of two layers, each state of each of them."""
    r = kept(_layers(spark, d), "records")  # read for the checks of rows and of units, and for the rollups
    expected = b.units(spark, d).where("unit % 43 <> 0")
    sums, v = [F.sum(c).alias(c) for c in FIELDS], F.col("values")
    one = r.where("source = 'a'").groupBy("unit").agg(F.min("place").alias("place"), *[F.min_by(v[c], v["total"]).alias(c) for c in FIELDS]).groupBy("place").agg(*sums)
    wrong = F.col("total") + (F.col("place") % 11 == 0).cast("int")
    declared = one.select(F.lit("a").alias("source"), "place", F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*[F.col(c) for c in FIELDS[:-1]], wrong)).alias("values"))
    nowhere = declared.limit(1).select("source", F.lit(-1).cast("long").alias("place"), "values")
    rules = [(s, "sum", FIELDS[:-1], "total") for s in "ab"]
    found = reconcile.full(r, expected, declared.unionByName(nowhere), "source", "unit", "place", FIELDS, rules, "total", "registered", "a", "b")
    return found.groupBy("check", "source", "field", "state").agg(F.count("*").alias("n"))


def _claims(spark, d) -> DataFrame:
    """Orders as records (id, atoms, scope): some ids twice, an atom of each customer's month, a few records of whole places
    or municipalities, and one atom that every 50th record has."""
    u, k = b.units(spark, d), F.col("unit")
    scope = F.when(k % 997 == 0, F.concat_ws("/", "department", "municipality")).when(k % 101 == 0, F.concat_ws("/", "department", "municipality", "place")).otherwise(F.concat_ws("/", "department", "municipality", "place", "unit"))
    month = F.concat_ws("-", F.col("place").cast("string"), F.date_format("o_orderdate", "yyyyMM"))
    rows = u.select((k - F.when(k % 89 == 0, 1).otherwise(0)).alias("id"), F.array(month, F.when(k % 50 == 0, "common")).alias("atoms"), F.when(k % 7 != 0, scope).alias("scope"))
    return rows


_ROUNDS = 12  # of least labels through tokens: more than the claims' classes need
_CLAIMS = """claims AS (SELECT unit - (unit % 89 = 0)::INT AS id, place || '-' || strftime(o_orderdate, '%Y%m') AS m, unit % 50 = 0 AS common,
  CASE WHEN unit % 7 <> 0 THEN CASE WHEN unit % 997 = 0 THEN concat_ws('/', department, municipality) WHEN unit % 101 = 0 THEN concat_ws('/', department, municipality, place) ELSE concat_ws('/', department, municipality, place, unit) END END AS scope FROM units),
atoms AS (SELECT DISTINCT id, m AS atom FROM claims UNION SELECT DISTINCT id, 'common' FROM claims WHERE common),
scopes AS (SELECT DISTINCT id, scope FROM claims WHERE scope IS NOT NULL),
inside AS (SELECT s.id, s.scope AS own, o.scope FROM scopes s, (SELECT DISTINCT scope FROM scopes) o WHERE o.scope IN (s.scope, array_to_string(string_split(s.scope, '/')[1:2], '/'), array_to_string(string_split(s.scope, '/')[1:3], '/'))),
tok AS (SELECT id, 'a:' || atom AS token FROM atoms UNION SELECT id, 's:' || scope FROM inside), l0 AS (SELECT DISTINCT id, id AS c FROM claims)"""


@query(f"""WITH {_CLAIMS}, {', '.join(f"l{k} AS MATERIALIZED (SELECT l{k - 1}.id, least(any_value(l{k - 1}.c), min(t.c)) AS c FROM l{k - 1} LEFT JOIN (SELECT tok.id, min(m.c) AS c FROM tok JOIN (SELECT token, min(c) AS c FROM tok JOIN l{k - 1} USING (id) GROUP BY token) m USING (token) GROUP BY tok.id) t USING (id) GROUP BY l{k - 1}.id)" for k in range(1, _ROUNDS + 1))},
al AS (SELECT id, sum(n - 1) AS n FROM atoms JOIN (SELECT atom, count(*) AS n FROM atoms GROUP BY atom) USING (atom) GROUP BY id),
sl AS (SELECT id, sum(CASE WHEN own = scope THEN w - 1 ELSE j END) AS n FROM inside JOIN (SELECT scope, count(DISTINCT id) AS w, count(DISTINCT CASE WHEN own = scope THEN id END) AS j FROM inside GROUP BY scope) USING (scope) GROUP BY id)
SELECT id, c AS class, k AS copies, coalesce(al.n, 0)::BIGINT AS atom_links, coalesce(sl.n, 0)::BIGINT AS scope_links FROM l{_ROUNDS} JOIN (SELECT id, count(*) AS k FROM claims GROUP BY id) USING (id) LEFT JOIN al USING (id) LEFT JOIN sl USING (id)""")
def overlap_classes(spark, d):
    """Classes of records with one id, a common atom or nested scopes; a very common atom among them."""
    return reconcile.overlap_classes(_claims(spark, d), "id", "atoms", "scope")


@query("""WITH t AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_type, ' ')) || '-' || p_size AS atom FROM part) SELECT a.id AS a, b.id AS b, count(*) AS shared FROM t a JOIN t b ON a.atom = b.atom AND a.id < b.id GROUP BY ALL""")
def overlapping_records(spark, d):
    """Records that share atoms."""
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.transform(F.split("p_type", " "), lambda x: F.concat(x, F.lit("-"), F.col("p_size").cast("string"))).alias("atoms"))
    return reconcile.overlapping_records(p, "id", "atoms")


@query("""WITH l AS (SELECT n_name AS l, replace(n_name, '_', ' ') AS ln FROM nation), r AS (SELECT n_name AS r, replace(n_name, '_', ' ') AS rn FROM nation WHERE n_nationkey % 2 = 0),
m AS (SELECT l, r, CASE WHEN ln = rn THEN 1 WHEN starts_with(rn, ln) OR starts_with(ln, rn) THEN 2 END AS tier FROM l, r), t AS (SELECT l, tier, count(*) AS k, min(r) AS r FROM m WHERE tier IS NOT NULL GROUP BY ALL),
f AS (SELECT *, min(tier) OVER (PARTITION BY l) AS first FROM t)
SELECT l.l AS label, r AS target, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'prefix' ELSE 'none' END AS basis FROM l LEFT JOIN (SELECT * FROM f WHERE tier = first AND k = 1) f ON l.l = f.l""")
def label_crosswalk(spark, d):
    """Labels matched by tiers."""
    n = b.table(spark, d, "nation")
    return crosswalk.label_crosswalk(n.select(F.col("n_name").alias("label")), n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("target")), "label", "target")


@query("""WITH o AS (SELECT n_nationkey AS code, n_name AS l FROM nation), n AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 6 = 0 THEN n_name || ' 2' ELSE n_name END AS l FROM nation WHERE n_nationkey <> 7)
SELECT o.code, o.l AS label_old, n.l AS label_new, CASE WHEN o.code = 24 THEN 'extraterritorial' WHEN n.l IS NULL THEN 'unmatched_absent' WHEN o.l <> n.l THEN 'unmatched_label' ELSE 'high' END AS status FROM o LEFT JOIN n USING (code)""")
def year_crosswalk(spark, d):
    """Codes of two years."""
    n = b.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("label"))
    new = n.where("code <> 7").withColumn("label", F.when(F.col("code") % 6 == 0, F.concat("label", F.lit(" 2"))).otherwise(F.col("label")))
    return crosswalk.year_crosswalk(n, new, "code", "label", F.col("code") == 24)


@query("""WITH a AS (SELECT municipality AS code, sum(votes) FILTER (WHERE year = 1995)::BIGINT AS x, sum(votes) FILTER (WHERE year = 1996)::BIGINT AS y FROM facts GROUP BY ALL)
SELECT code, x AS votes_old, y AS votes_new, y - x AS votes_change FROM a WHERE x IS NOT NULL AND y IS NOT NULL""")
def year_changes(spark, d):
    """J13."""
    f = b.facts(spark, d)
    year = lambda y: f.where(F.col("year") == y).groupBy(F.col("municipality").alias("code")).agg(F.sum("votes").alias("votes"))
    walk = b.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.lit("high").alias("status"))
    return crosswalk.changes(walk, year(1995), year(1996), "code", ["votes"])


@query("""WITH a AS (SELECT n_regionkey AS department, replace(n_name, '_', ' ') AS norm, n_nationkey AS v FROM nation WHERE n_nationkey % 5 <> 1), p AS (SELECT n_regionkey AS department, replace(n_name, '_', ' ') AS norm, n_nationkey + 2 AS w FROM nation WHERE n_nationkey % 5 <> 2)
SELECT coalesce(a.department, p.department) AS department, coalesce(a.norm, p.norm) AS norm, CASE WHEN coalesce(a.department, p.department) = 4 THEN 'extraterritorial' WHEN a.norm IS NULL THEN 'missing_census' WHEN p.norm IS NULL THEN 'missing_population' ELSE 'exact' END AS status,
  CASE WHEN coalesce(a.department, p.department) <> 4 AND a.norm IS NOT NULL AND p.norm IS NOT NULL THEN round(v::DOUBLE / w, 9) END AS ratio FROM a FULL JOIN p ON a.department = p.department AND a.norm = p.norm""")
def census_join(spark, d):
    """J10, U5."""
    n = b.table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("department"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("k"))
    out = crosswalk.census_join(n.where("k % 5 <> 1").withColumnRenamed("k", "v"), n.where("k % 5 <> 2").select("department", "label", (F.col("k") + 2).alias("w")), "department", "label", "v", "w", F.col("department") == 4)
    return out.withColumn("ratio", F.round("ratio", 9))


@query("""WITH l AS (SELECT municipality AS place, category, sum(votes)::BIGINT AS v FROM facts WHERE year = 1995 GROUP BY ALL), r AS (SELECT municipality AS place, category, sum(votes)::BIGINT AS v FROM facts WHERE year = 1996 GROUP BY ALL)
SELECT l.place, l.category, l.v AS left_value, CASE WHEN reason IS NULL THEN rv END AS right_value, CASE WHEN reason IS NULL THEN rv - l.v END AS change, reason
FROM (SELECT l.*, r.v AS rv, CASE WHEN l.place % 9 = 0 THEN 'no_place_crosswalk' WHEN l.place % 5 = 0 THEN 'place_not_approved' WHEN l.category = 'NF' THEN 'category_not_approved' WHEN r.v IS NULL THEN 'not_published' END AS reason
FROM l LEFT JOIN r ON l.place = r.place AND l.category = r.category) l""")
def release_comparison(spark, d):
    """Two releases through reviewed crosswalks."""
    f = b.facts(spark, d)
    side = lambda y: f.where(F.col("year") == y).groupBy(F.col("municipality").alias("place"), "category").agg(F.sum("votes").alias("votes"))
    n = b.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("left_place"))
    g = n.where("left_place % 9 <> 0").select("left_place", F.col("left_place").alias("right_place"), (F.col("left_place") % 5 != 0).alias("approved"))
    c = f.select("category").distinct().select(F.col("category").alias("left_category"), F.col("category").alias("right_category"), (F.col("category") != "NF").alias("approved"))
    return crosswalk.release_comparison(side(1995), side(1996), g, c, "votes")


@query("""SELECT source, unit, 'sum' AS rule, CASE WHEN rf IS NULL OR nf IS NULL THEN 'not_evaluable' WHEN rf + nf = t THEN 'pass' ELSE 'fail' END AS result,
  CASE WHEN rf IS NULL AND nf IS NULL THEN 'missing: RF,AF' WHEN rf IS NULL THEN 'missing: RF' WHEN nf IS NULL THEN 'missing: AF' END AS reason
FROM (SELECT source, unit, sum(votes) FILTER (WHERE category = 'RF') AS rf, sum(votes) FILTER (WHERE category = 'AF') AS nf, sum(votes) AS t FROM sources GROUP BY ALL) WHERE source = 'a'""")
def source_arithmetic(spark, d):
    """Q1: declared accounting rules of a source."""
    pick = [F.sum(F.when(F.col("category") == c, F.col("votes"))).alias(c) for c in b.CATEGORIES]  # one aggregation, no pivot, no join
    t = b.sources(spark, d).groupBy("source", "unit").agg(*pick, F.sum("votes").alias("total"))
    return reconcile.arithmetic(t, [("a", "sum", ["RF", "AF"], "total")], "source", ["unit"])


@query("""WITH s AS (SELECT unit, CASE WHEN unit % 7 <> 0 THEN 1 END AS v, CASE WHEN unit % 10 = 0 THEN 'observed' WHEN unit % 7 <> 0 THEN 'observed' ELSE 'unavailable' END AS st FROM (SELECT DISTINCT unit FROM facts))
SELECT unit, 'votes' AS metric, 'invalid_state' AS finding FROM s WHERE (st = 'observed') <> (v IS NOT NULL)""")
def value_states(spark, d):
    """Q3."""
    s = b.stateful(spark, d).withColumn("votes_status", F.when(F.col("unit") % 10 == 0, "observed").otherwise(F.col("votes_status")))
    return quality.value_states(s, [b.VOTES], ["unit"])


@query("""SELECT unit, 'voters_exceed_registered' AS finding FROM (SELECT unit, sum(votes) AS v FROM facts GROUP BY unit) WHERE v > 100 + unit % 50""")
def elector_bounds(spark, d):
    """Q2."""
    from tallyloom.schema import Metric

    u = b.facts(spark, d).groupBy("unit").agg(F.sum("votes").alias("voters")).select("unit", "voters", F.lit("observed").alias("voters_status"), (100 + F.col("unit") % 50).alias("registered"), F.lit("observed").alias("registered_status"))
    return quality.elector_bounds(u, Metric("voters"), Metric("registered"), ["unit"])


@query("""WITH f AS (SELECT source, unit, CASE WHEN source = 'a' THEN 'scrutiny' ELSE 'precount' END AS t, CASE WHEN unit % 8 = 0 THEN 'official' WHEN source = 'a' THEN 'official' ELSE 'informative' END AS l, unit % 9 = 0 AS inferred, count(*) OVER (PARTITION BY source, unit) AS n FROM sources)
SELECT DISTINCT source, unit, finding FROM (SELECT source, unit, unnest([CASE WHEN source = 'b' AND l <> 'informative' THEN 'legal_status_mismatch' END, CASE WHEN source = 'b' AND l <> 'informative' THEN 'illegal_status' END, CASE WHEN inferred THEN 'inferred' END, CASE WHEN n > 1 THEN 'duplicate' END]) AS finding FROM f) WHERE finding IS NOT NULL""")
def fact_layers(spark, d):
    """Q4: facts against the layer of their source."""
    kind = F.when(F.col("source") == "a", "scrutiny").otherwise("precount")
    law = F.when(F.col("source") == "a", "official").otherwise("informative")
    f = b.sources(spark, d).select("source", "unit", kind.alias("source_type"), F.when(F.col("unit") % 8 == 0, "official").otherwise(law).alias("legal_status"), (F.col("unit") % 9 == 0).alias("inferred"), F.lit(False).alias("ambiguous"))
    s = b.sources(spark, d).select("source").distinct().select("source", kind.alias("source_type"), law.alias("legal_status"))
    return quality.fact_layers(f, s, "source", ["unit"], {"scrutiny": "official", "precount": "informative"})


@query("""WITH w AS (SELECT unit, sum(votes) FILTER (WHERE category = 'AF') AS a, sum(votes) FILTER (WHERE category = 'RF') AS r, sum(votes) FILTER (WHERE category = 'NO') AS o, sum(votes) AS t FROM facts GROUP BY unit),
x AS (SELECT unit, a, r, a + r + (unit % 3 = 0)::INT AS valid, o, t FROM w)
SELECT unit, unnest(list_filter([CASE WHEN a + r <> valid THEN 'valid_votes' END, CASE WHEN valid + o + 0 <> t THEN 'voters' END], lambda f: f IS NOT NULL)) AS finding FROM x""")
def result_arithmetic(spark, d):
    """Q5: accounting identities where all operands are there."""
    pick = [F.sum(F.when(F.col("category") == c, F.col("votes"))).alias(c) for c in b.CATEGORIES]  # one aggregation, no pivot, no join
    w = b.facts(spark, d).groupBy("unit").agg(*pick, F.sum("votes").alias("t"))
    w = w.withColumn("valid", F.col("AF") + F.col("RF") + (F.col("unit") % 3 == 0).cast("int")).withColumn("zero", F.lit(0))
    return quality.result_arithmetic(w, "AF", "RF", "NO", "zero", "valid", "t", ["unit"])


@query("SELECT l_orderkey AS unit, l_returnflag AS flag, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def semantic_keys(spark, d):
    """Q6: keys that stand more than once."""
    return quality.semantic_keys(b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("flag")), ["unit", "flag"])


@query("SELECT p_size::BIGINT AS code, count(DISTINCT p_brand) AS names FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) > 1")
def conflicting_names(spark, d):
    """Q6: codes with several names."""
    return quality.conflicting_names(b.table(spark, d, "part").select(F.col("p_size").cast("long").alias("code"), F.col("p_brand").alias("name")), ["code"], "name")


@query("""WITH f AS (SELECT 'without_result' AS gate, '{"place":' || c_custkey || '}' AS j FROM customer WHERE c_custkey NOT IN (SELECT place FROM units)
  UNION ALL SELECT 'orphans', '{"id":"' || id || '"}' FROM geo WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM geo) UNION ALL SELECT 'duplicate_units', unit::VARCHAR FROM units GROUP BY unit HAVING count(*) > 1),
p AS (SELECT gate, substr(sha256(sha256(j)), 1, 2) AS b, count(*) AS n, sha256(string_agg(sha256(j), ';' ORDER BY sha256(j))) AS d FROM f GROUP BY ALL), r AS (SELECT gate, sum(n)::BIGINT AS n, sha256(string_agg(b || '=' || d, ';' ORDER BY b)) AS digest FROM p GROUP BY gate)
SELECT g.gate, coalesce(n, 0) AS findings, coalesce(n, 0) = 0 AS passes, coalesce(digest, sha256('')) AS digest FROM (VALUES ('duplicate_units'), ('orphans'), ('without_result')) g(gate) LEFT JOIN r USING (gate)""")
def release_gates(spark, d):
    """Q9: gates of a release with their findings and digests of these."""
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("place"))
    return quality.verify({"duplicate_units": quality.semantic_keys(b.units(spark, d), ["unit"]), "orphans": rollup.orphans(b.geo(spark, d)), "without_result": reconcile.without_result(c, b.units(spark, d), "place")})


@query("""SELECT l_linestatus AS round, count(DISTINCT (l_returnflag)) AS provenances, 0 AS unknown FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1""")
def provenance_constant(spark, d):
    """Q8."""
    l = b.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("round"), "l_returnflag")
    return quality.provenance_constant(l, "round", ["l_returnflag"], l)


@query("""SELECT place AS unit, 'missing_result' AS anomaly FROM (SELECT c_custkey AS place FROM customer) WHERE place NOT IN (SELECT place FROM facts)
UNION ALL SELECT place, 'inconsistent_ballot_vector' FROM (SELECT place, sum(votes) AS v FROM facts GROUP BY place) WHERE v % 10 = 0""")
def anomalies(spark, d):
    """A36."""
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("unit"))
    f = b.facts(spark, d).groupBy(F.col("place").alias("unit")).agg((F.sum("votes") % 10 != 0).alias("complete"))
    return quality.anomalies(c, f, "unit", "complete")


@query("""WITH m AS (SELECT department, sha256(len(unit::VARCHAR) || ':' || unit || ';' || len(n::VARCHAR) || ':' || n || ';') AS h FROM rates),
p AS (SELECT department, substr(sha256(h), 1, 2) AS b, count(*) AS k, sha256(string_agg(h, ';' ORDER BY h)) AS x FROM m GROUP BY ALL)
SELECT department, sum(k)::BIGINT AS members, sha256(string_agg(b || '=' || x, ';' ORDER BY b)) AS digest FROM p GROUP BY department""")
def set_digests(spark, d):
    """Order-independent digests."""
    h = b.rates(spark, d).withColumn("h", digest.tuple_hash(F.col("unit"), F.col("n")))
    return digest.set_digest(h, ["department"], "h")


def _tampered(spark, d) -> DataFrame:
    """Units by department as declared: one of department 1 is another, one of department 2 is left out, 3 is not declared."""
    u = b.units(spark, d).select("department", "unit")
    first = u.groupBy("department").agg(F.min("unit").alias("first"))
    kept = u.join(first, "department").where("department <> 3 and not (department = 2 and unit = first)")
    return kept.select("department", F.when((F.col("department") == 1) & (F.col("unit") == F.col("first")), -F.col("unit")).otherwise(F.col("unit")).alias("unit"))


@query("""WITH t AS (SELECT department, unit, min(unit) OVER (PARTITION BY department) AS first FROM units), l AS (SELECT department, unit FROM t), r AS (SELECT department, CASE WHEN department = 1 AND unit = first THEN -unit ELSE unit END AS unit FROM t WHERE department <> 3 AND NOT (department = 2 AND unit = first)),
h AS (SELECT 'l' AS side, department, substr(sha256(sha256(len(unit::VARCHAR) || ':' || unit || ';')), 1, 2) AS bucket, unit FROM l UNION ALL SELECT 'r', department, substr(sha256(sha256(len(unit::VARCHAR) || ':' || unit || ';')), 1, 2), unit FROM r)
SELECT department, bucket, count(*) FILTER (WHERE side = 'l') AS left_members, count(*) FILTER (WHERE side = 'r') AS right_members FROM h GROUP BY ALL HAVING list_sort(list(unit) FILTER (WHERE side = 'l')) IS DISTINCT FROM list_sort(list(unit) FILTER (WHERE side = 'r'))""")
def digest_differences(spark, d):
    """Where the digest trees of two sets differ."""
    tree = lambda u: digest.digest_tree(u.withColumn("h", digest.tuple_hash(F.col("unit"))), ["department"], "h")
    return digest.tree_differences(tree(b.units(spark, d)), tree(_tampered(spark, d)), ["department"])


@query("""WITH g AS (SELECT *, CASE department WHEN 1 THEN 'family_digest_differs' WHEN 2 THEN 'family_count_differs' WHEN 3 THEN 'family_undeclared' END AS family_reason FROM rates),
c AS (SELECT *, eligible AND family_reason IS NULL AS ok FROM g), p AS (SELECT *, sum(ok::INT) OVER (PARTITION BY place) - ok::INT AS n1, sum(ok::INT) OVER (PARTITION BY municipality) - ok::INT AS n2 FROM c)
SELECT unit, department, CASE WHEN NOT ok THEN NULL WHEN n1 >= 30 THEN 'place' WHEN n2 >= 30 THEN 'municipality' END AS pool, coalesce(family_reason, CASE WHEN NOT ok THEN 'not_eligible' WHEN n1 < 30 AND n2 < 30 THEN 'fewer_than_30_eligible_peers' END) AS reason FROM p""")
def family_gate(spark, d):
    """Peer screen by family, of which three are not as declared: their units abstain."""
    from tallyloom.operators import screens

    h = _tampered(spark, d).join(b.rates(spark, d).select(F.abs("unit").alias("u")), F.abs("unit") == F.col("u"), "left_semi")
    declared = digest.set_digest(h.withColumn("h", digest.tuple_hash(F.col("unit"))), ["department"], "h")
    r = screens.complete_families(screens.peer_screen_moments, b.rates(spark, d), declared, "department", "unit", ["place", "municipality"], "y", "n", "eligible")
    return r.select("unit", "department", "pool", "reason")


@query("SELECT unit, sha256(len(unit::VARCHAR) || ':' || unit || ';' || len(n::VARCHAR) || ':' || n || ';') AS h, sha256('{\"n\":' || n || ',\"unit\":' || unit || '}') AS j FROM rates")
def row_hashes(spark, d):
    """Canonical row hashes."""
    return b.rates(spark, d).select("unit", digest.tuple_hash(F.col("unit"), F.col("n")).alias("h"), digest.row_hash(["unit", "n"]).alias("j"))


@query("""SELECT p.unit, source, category, votes FROM sources p JOIN units u ON p.unit = u.unit WHERE department = 2 AND source = 'a' AND (p.unit, category) > (100, 'NO') ORDER BY p.unit, category LIMIT 51""")
def keyset_page(spark, d):
    """Filtered star join, one keyset page."""
    s = read.filtered(b.sources(spark, d), source="a", category=None)
    rows = read.star(s, b.units(spark, d).where("department = 2").select("unit", "department"), b.units(spark, d).select("unit", F.col("municipality").alias("m")), "unit", "unit")
    return read.page(rows.select("unit", "source", "category", "votes"), ["unit", "category"], (100, "NO"), 50)


@query("""WITH t AS (SELECT concat_ws('/', department, municipality) AS id, category, sum(votes)::BIGINT AS v FROM facts WHERE municipality % 3 <> 0 GROUP BY ALL)
SELECT g.id, sum(v)::BIGINT AS total, coalesce(string_agg(category || '=' || v, ';' ORDER BY category), '') AS categories, sum(v) IS NOT NULL AS has_facts FROM (SELECT id FROM geo WHERE parent_id = '2') g LEFT JOIN t USING (id) GROUP BY g.id""")
def children_with_facts(spark, d):
    """Children of a place with totals and ordered categories."""
    f = b.facts(spark, d).where("municipality % 3 <> 0").groupBy(F.concat_ws("/", "department", "municipality").alias("id"), "category").agg(F.sum("votes").alias("votes"))
    r = read.children(b.geo(spark, d), f, "2", "category", "votes")
    text_ = F.array_join(F.transform("categories", lambda c: F.concat_ws("=", c["category"], c["value"].cast("string"))), ";")
    return r.select("id", "total", F.coalesce(text_, F.lit("")).alias("categories"), "has_facts")


@query("SELECT unit, department FROM units WHERE unit IN (SELECT unit FROM facts WHERE category = 'RF' AND votes > 40)")
def having_category(spark, d):
    """F8."""
    return read.having(b.units(spark, d).select("unit", "department"), b.facts(spark, d), ["unit"], (F.col("category") == "RF") & (F.col("votes") > 40))


@query("SELECT unit, count(*) AS n, max(CASE WHEN category = 'RF' THEN votes END) AS rf FROM facts GROUP BY unit HAVING bool_or(category = 'RF')")
def array_filters(spark, d):
    """Array membership and narrowing."""
    a = b.facts(spark, d).groupBy("unit").agg(F.collect_list(F.struct("category", "votes")).alias("cs"))
    hit = read.with_member(a, "cs", "category", "RF").withColumn("n", F.size("cs"))
    return read.narrowed(hit, "cs", "category", "RF").select("unit", "n", F.col("cs")[0]["votes"].alias("rf"))


@query("""SELECT unit, m AS metric, nume::BIGINT AS numerator, n AS denominator FROM (SELECT unit, n, unnest(['share', 'turnout']) AS m, unnest([y, n]) AS nume FROM rates)""")
def long_metrics(spark, d):
    """wide facts as long metric rows."""
    return read.long_metrics(b.rates(spark, d), ["unit"], {"share": ("y", "n"), "turnout": ("n", "n")})


@query("""WITH s AS (SELECT unit, source, sum(votes)::BIGINT AS v FROM sources GROUP BY ALL) SELECT u.unit, department, municipality, place, string_agg(source || '=' || v, ';' ORDER BY source) AS sources FROM units u LEFT JOIN s USING (unit) GROUP BY ALL""")
def unit_detail(spark, d):
    """Units with ancestors and each source's facts."""
    u = b.units(spark, d)
    r = read.unit_detail(u.select("unit"), u.select("unit", "department", "municipality", "place"), b.sources(spark, d), "unit", "source", "votes")
    return r.withColumn("sources", F.array_join(F.transform("sources", lambda s: F.concat_ws("=", s["source"], s["votes"].cast("string"))), ";"))


@query("SELECT source, unit, category, votes, s.t AS source_type FROM sources JOIN (SELECT 'a' AS source, 'scrutiny' AS t UNION ALL SELECT 'b', 'precount') s USING (source) WHERE (unit, source, category) > (500, 'a', 'AF') ORDER BY unit, source, category LIMIT 101")
def category_page(spark, d):
    """J32."""
    kinds = b.sources(spark, d).select("source").distinct().withColumn("source_type", F.when(F.col("source") == "a", "scrutiny").otherwise("precount"))
    return read.category_page(b.sources(spark, d), kinds, "source", ["unit", "source", "category"], (500, "a", "AF"), 100)


@query("SELECT level, id FROM geo ORDER BY CASE level WHEN 'department' THEN 1 WHEN 'municipality' THEN 2 WHEN 'place' THEN 3 ELSE 4 END, id")
def level_order(spark, d):
    """By rank of level, then id."""
    return read.by_level(b.geo(spark, d), "level", list(b.H.levels), "id").select("level", "id")


@query("""SELECT doc_id, regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9-]+(\\.[a-z0-9-]+)*\\.[a-z]{2,}') AS email, len(regexp_extract_all(text, '(https?://[^\\s\"''<>\\\\]+)', 1)) AS urls FROM documents""")
def personal_data(spark, d):
    """Personal data and URLs in whole texts."""
    t = b.table(spark, d, "documents")
    return t.select("doc_id", F.array_contains(text.personal_findings(F.col("text")), "email").alias("email"), F.size(text.urls(F.col("text"))).alias("urls"))


@query("SELECT host, count(*) AS pages, sum(CASE WHEN starts_with(url, 'https://') THEN 1 ELSE 0 END)::BIGINT AS https FROM (SELECT url, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), '')) AS host FROM pages) GROUP BY host")
def hosts(spark, d):
    """X13."""
    return b.table(spark, d, "pages").select("url", text.host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.col("url").startswith("https://").cast("long")).alias("https"))


@query("""SELECT p_partkey, trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) AS label, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS compact, lpad(p_size::VARCHAR, 4, '0') AS code,
  CASE WHEN p_size <= 2 THEN '1-2' WHEN p_size <= 5 THEN '3-5' WHEN p_size <= 10 THEN '6-10' WHEN p_size <= 20 THEN '11-20' ELSE '21+' END AS band,
  CASE WHEN p_size >= 70 THEN 'high' WHEN p_size >= 45 THEN 'medium' WHEN p_size >= 15 THEN 'low' ELSE 'none' END AS tier FROM part""")
def labels(spark, d):
    """Labels, codes, bands, tiers."""
    return b.table(spark, d, "part").select("p_partkey", text.exact_label(F.col("p_name")).alias("label"), text.compact_label(F.col("p_name")).alias("compact"), text.code(F.col("p_size"), 4).alias("code"), text.size_band(F.col("p_size")).alias("band"), text.tier(F.col("p_size")).alias("tier"))


@query("""WITH a AS (SELECT count(*) AS rows, sum(l_quantity)::BIGINT AS s, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS k FROM lineitem), t AS (SELECT unnest(['rows', 'sum', 'repeated_keys']) AS "check", unnest([rows, s, k]) AS actual FROM a
UNION ALL SELECT 'kind:' || l_returnflag, count(*) FROM lineitem GROUP BY ALL), p AS (SELECT "check", actual + ("check" = 'kind:R')::INT AS expected FROM t WHERE "check" <> 'kind:A')
SELECT "check", expected, actual, CASE WHEN expected = actual THEN 'equal' ELSE 'different' END AS status FROM t LEFT JOIN p USING ("check")""")
def pinned_totals(spark, d):
    """Totals of a source against pinned ones, of which one is wrong and one missing."""
    l = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    n = l.agg(F.count("*").alias("rows"), F.sum("l_quantity").cast("long").alias("sum"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "N").alias("n"), (F.count("*") - F.countDistinct("l_orderkey", "l_linenumber")).alias("k"))
    pins = n.select(F.explode(F.create_map(F.lit("rows"), F.col("rows"), F.lit("sum"), F.col("sum"), F.lit("repeated_keys"), F.col("k"), F.lit("kind:R"), F.col("r") + 1, F.lit("kind:N"), F.col("n"))).alias("check", "expected"))
    return quality.pinned_totals(l, ["l_orderkey", "l_linenumber"], "l_quantity", "l_returnflag", pins)


@query("""SELECT event_type, shape, count(*) AS count FROM (SELECT event_type, replace(replace(replace(replace(json_structure(props)::VARCHAR, 'UBIGINT', 'int'), 'BIGINT', 'int'), 'DOUBLE', 'float'), 'VARCHAR', 'text') AS shape FROM events) GROUP BY ALL""")
def json_shapes(spark, d):
    """Shapes of raw payloads by type, with counts."""
    return b.table(spark, d, "events").select("event_type", digest.json_shape(F.col("props")).alias("shape")).groupBy("event_type", "shape").count()
