"""Small hand-built cases: text, states, numbers, quarantine, abstention."""

from __future__ import annotations

import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F


from tallyloom.functions import digest, likelihood, stats, text
from tallyloom.operators import composition, crosswalk, quality, reconcile, rollup, score, screens, windows
from tallyloom.schema import Metric
from tallyloom.sources import counts


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.exact_label, "  Ñandú–Río, 3º ", "NANDU RIO 3"), (text.compact_label, "Río-Negro 2", "rionegro2"), (lambda c: text.code(c, 3), "7", "007"), (lambda c: text.code(c, 3), "a7", None),
        (lambda c: text.code(c, 2), "123", None), (text.clean, "  ", None), (text.localized_integer, "1.234.567", 1234567), (text.localized_integer, "1 234", 1234), (text.localized_integer, "1.23", None),
        (text.csv_safe, "=1+1", "'=1+1"), (text.csv_safe, "ok", "ok"), (text.host, "HTTPS://A.example/x", "a.example"), (text.value_state, "pendiente", "unknown"), (text.value_state, "n.a.", "unavailable"),
        (text.value_state, "0", "observed"), (text.value_state, None, "unavailable"), (text.value_state, "zz", None), (text.is_sha256, "a" * 64, True), (text.is_sha256, None, False),
        (lambda c: text.https_ok(c, ["a.example"]), "https://a.example/x", True), (lambda c: text.https_ok(c, ["a.example"]), "http://a.example/x", False),
        (text.ancestors, "r1:place:05:001:03", ["r1:place:05", "r1:place:05:001", "r1:place:05:001:03"]), (text.personal_findings, "mail a@b.co or 300-555-1234", ["email", "phone"]),
        (lambda c: text.payload_class(c, ["a", "b"], ["a"]), '{"a":1,"z":2}', "extended"), (lambda c: text.payload_class(c, ["a"], ["a"]), "[1]", "not_an_object"),
        (digest.json_shape, '{"b":[1,2],"a":null}', '{"a":"null","b":["int"]}'), (digest.json_shape, "{", None),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


def test_percentage_and_time(spark):
    assert str(one(spark, "12,5 %", text.localized_percentage)) == "12.5000" and one(spark, "101", text.localized_percentage) is None
    assert one(spark, "2024-01-01T00:00:00Z", text.zoned_timestamp) is not None and one(spark, "2024-01-01T00:00:00", text.zoned_timestamp) is None


def test_combined_states(spark):
    rows = [(1, "observed", 2, "observed"), (None, "unknown", 2, "observed"), (None, "unknown", None, "unavailable"), (None, "not_applicable", 2, "observed")]
    df = spark.createDataFrame(rows, "a long, a_status string, b long, b_status string")
    v, s = text.combined("a", "b")
    assert [tuple(r) for r in df.select(v, s).collect()] == [(3, "observed"), (None, "unknown"), (None, "unavailable"), (None, "not_applicable")]


def test_beta_binomial():
    p = np.exp(stats.log_pmf(40, 2.5, 7.0))
    assert abs(p.sum() - 1) < 1e-12
    k = np.arange(41)
    direct = [math.exp(math.lgamma(41) - math.lgamma(i + 1) - math.lgamma(41 - i) + math.lgamma(i + 2.5) + math.lgamma(47 - i) - math.lgamma(49.5) + math.lgamma(9.5) - math.lgamma(2.5) - math.lgamma(7.0)) for i in k]
    assert np.allclose(p, direct, rtol=1e-10)
    two = stats.tails(12, 40, 2.5, 7.0)[0]
    assert abs(two - min(1, 2 * min(sum(direct[:13]), sum(direct[12:])))) < 1e-10


def test_fits_agree():
    rng = np.random.default_rng(0)
    n = rng.integers(80, 200, 60).astype(float)
    y = rng.binomial(n.astype(int), rng.beta(8, 12, 60)).astype(float)
    w = rng.integers(1, 3, 60).astype(float)
    all_ = likelihood.left_out(y, n, w)
    for i in (0, 17, 59):
        v = w.copy()
        v[i] -= 1
        mean, conc, how = brute.likelihood_fit(y[v > 0], n[v > 0], v[v > 0])
        assert how == all_[i][2] == "likelihood" and abs(mean - all_[i][0]) < 1e-6 and abs(conc / all_[i][1] - 1) < 1e-4


def test_chi_square_tail_and_bounds(spark):
    assert abs(one(spark, stats.CHI2_9_95, stats.chi2_sf_9, "double") - 0.05) < 1e-9
    low, high = stats.clopper_pearson(3, 10)
    assert abs(low - 0.0667395) < 1e-6 and abs(high - 0.6524529) < 1e-6
    assert stats.clopper_pearson(0, 10)[0] == 0 and stats.clopper_pearson(10, 10)[1] == 1


def test_haversine(spark):
    r = spark.range(1).select(stats.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("k")).first().k
    assert abs(r - 111.19508) < 1e-4


def test_quarantine(spark, tmp_path):
    head = ";".join(counts.HEADER)
    rows = ["1;A;2;B;3;A3;P;4;7;C;0;1;p;1;c;10", "x;A;2;B;3;4;P;4;7;C;0;1;p;1;c;10", "1;A;2;B;3;4;P;4;7;C;0;1;p;1;c;10001", "1;;2;B;3;4;P;4;7;C;0;1;p;1;c;1"]
    (tmp_path / "a.csv").write_text("\n".join([head, *rows]), encoding="latin-1")
    good, bad = counts.read_counts(spark, str(tmp_path / "a.csv"))
    assert [(r.dep, r.place, r.votes) for r in good.collect()] == [("01", "A3", 10)]
    assert sorted(r.reason for r in bad.collect()) == ["bad_code_DEP", "empty_DEPNOMBRE", "votes_out_of_bounds"]
    (tmp_path / "b.csv").write_text("A;B\n1;2")
    with pytest.raises(ValueError, match="header"):
        counts.read_counts(spark, str(tmp_path / "b.csv"))


def test_dialect(spark):
    raw = spark.createDataFrame([("5", None), ("6", "Six")], "c string, n string")
    out = counts.with_dialect(raw, {"MUN": "c", "MUNNOMBRE": "n", "X": None}, {"MUNNOMBRE": ("mun", "MUN")})
    assert [tuple(r) for r in out.collect()] == [("5", "official-mun-code-5", None), ("6", "Six", None)]


def test_bad_documents(spark):
    df = spark.createDataFrame([(1, "{"), (2, '{"totals":{"a":"zz","b":"3"},"parties":[]}')], "k int, raw string")
    good, bad = counts.count_documents(df, "raw", ["k"])
    assert [(r.k, r.metric, r.value) for r in good.collect()] == [(2, "b", 3)]
    assert sorted((r.k, r.reason) for r in bad.collect()) == [(1, "not_a_count_document"), (2, "unreadable_value")]


def test_unit_lists_and_plans(spark):
    docs = spark.createDataFrame([('{"mapagan":[{"url":"https://a/1"},{"url":"https://a/1"},{"url":"http://b/2"}]}',)], "raw string")
    good, bad = counts.unit_list(docs, "raw", "https://a/")
    assert good.count() == 1 and {r.finding for r in bad.collect()} == {"foreign_prefix", "repeated"}
    plan, twice = counts.index_plan(spark.createDataFrame([('{"p":"f","q":"f","r":"g"}',)], "raw string"), "raw", "https://a/")
    assert plan.count() == 3 and twice.first().file == "f"


def test_unobserved_part_blocks_the_sum(spark):
    df = spark.createDataFrame([("a", 1, 5, "observed"), ("a", 2, None, "unknown"), ("b", 3, 0, "observed")], "g string, u int, votes long, votes_status string")
    from tallyloom.schema import Hierarchy

    got = {r.g: (r.votes, r.votes_status) for r in rollup.stateful_rollup(df, Hierarchy(("g", "u")), "g", Metric("votes"), "u").collect()}
    assert got == {"a": (None, "unavailable"), "b": (0, "observed")}


def test_composition_without_votes(spark):
    df = spark.createDataFrame([("a", "x", 0), ("b", "x", 4), ("b", "blank", 9)], "g string, c string, v long")
    got = {r.g: r for r in composition.composition(df, ["g"], "c", "v", F.col("c") != "blank").collect()}
    assert got["a"].hhi is None and got["b"].hhi == 1 and got["b"].entropy == 0


def test_ambiguous_codes_are_not_matched(spark):
    a = spark.createDataFrame([("1", "X"), ("1", "Y"), ("2", "Z"), ("3", "official-mun-code-3")], "code string, label string")
    b = spark.createDataFrame([("1", "X"), ("2", "Z"), ("3", "W")], "code string, label string")
    got = {r.code: r.status for r in crosswalk.year_crosswalk(a, b, "code", "label", F.lit(False)).collect()}
    assert got == {"1": "ambiguous", "2": "high", "3": "unmatched_placeholder"}


def test_aliases(spark):
    df = spark.createDataFrame([("d", "A"), ("d", "B")], "dep string, label string")
    al = spark.createDataFrame([("d", "A", "A2"), ("d", "B", "C"), ("d", "B", "D")], "dep string, label string, target string")
    out, bad = crosswalk.apply_aliases(df, al, ["dep"], "label")
    assert {r.label: r.matched_label for r in out.collect()} == {"A": "A2", "B": "B"} and bad.first().finding == "repeated_label"


def test_absent_is_not_zero(spark):
    df = spark.createDataFrame([("a", 1, "x", 3), ("b", 1, "x", 4), ("b", 1, "y", 1)], "s string, u int, c string, v long")
    r = reconcile.compare_sources(df, "s", "a", "b", ["u"], "c", "v").first()
    assert (r.comparable, r.difference, r.min_edits) == (False, None, None)


def test_scopes_nest(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a/b"), (3, "ab"), (4, "a/b")], "id int, path string")
    assert sorted(map(tuple, reconcile.nested_scopes(df, "id", "path").collect())) == [(1, 2), (1, 4), (2, 4)]


def test_manifest_findings(spark):
    schema = "release_id string, sources array<struct<content_hash:string,retrieved_at:string,url:string>>, datasets array<struct<sha256:string,rows:long>>, coverage struct<expected:int,retrieved:int,parsed:int,missing:int,ambiguous:int,excluded:int>"
    good = ("g", [("a" * 64, "2024-01-01T00:00:00Z", "https://x")], [("b" * 64, 3)], (3, 2, 2, 1, 0, 0))
    bad = ("b", [("zz", "2024-01-01", "http://x")], [("b", -1)], (3, 1, 2, 1, 0, 0))
    rows = quality.manifests(spark.createDataFrame([good, bad], schema)).collect()
    assert {r.release_id for r in rows} == {"b"} and len(rows) == 6


def test_priority_is_the_largest(spark):
    u = spark.createDataFrame([(1,), (2,), (3,)], "unit int")
    e = spark.createDataFrame([(1, "coverage", 0), (1, "difference", 2), (2, "statistic", 9)], "unit int, kind string, edits int")
    got = {r.unit: (r.score, r.tier, r.kinds) for r in score.audit_priority(u, e, "unit").collect()}
    assert got == {1: (45, "medium", ["coverage", "difference"]), 2: (0, "none", []), 3: (0, "none", [])}


def test_spatial_units(spark):
    rows = [(1, "m", 1.0, 1.0, 1.0, 10.0, False), (1, "m", 1.0, 1.0, 3.0, 10.0, False), (2, "m", 2.0, 1.0, 1.0, 10.0, False), (3, "m", 2.0, 1.0, 1.0, 10.0, False), (4, "m", None, 1.0, 1.0, 10.0, False), (5, "m", 1.0, 2.0, 1.0, 900.0, False), (6, "m", 1.0, 3.0, 1.0, 1.0, False), (6, "m", 1.0, 4.0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "u int, m string, lat double, lon double, r double, acc double, cross boolean")
    got = {r.u: (r.status, r.r) for r in screens.spatial_units(df, "u", "m", "lat", "lon", "r", "acc", "cross").collect()}
    assert got[1] == ("ok", 2.0) and {u: s for u, (s, _) in got.items()} == {1: "ok", 2: "colocated", 3: "colocated", 4: "invalid", 5: "invalid", 6: "inconsistent"}


def test_q_values_of_nulls(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, None), ("f", 3, 0.5)], "f string, id int, p double")
    got = {r.id: (r.rank, r.q) for r in windows.by_adjust(df, "f", "p", "id").collect()}
    assert got[2] == (None, None) and got[1][0] == 1 and abs(got[1][1] - 0.01 * 2 * 1.5) < 1e-12


def test_set_digest_ignores_order(spark):
    a = spark.createDataFrame([("g", "x"), ("g", "y"), ("g", "z")], "g string, m string")
    b = spark.createDataFrame([("g", "z"), ("g", "x"), ("g", "y")], "g string, m string").repartition(3)
    c = a.where("m <> 'z'")
    d = [digest.set_digest(x, ["g"], "m").first().digest for x in (a, b, c)]
    assert d[0] == d[1] != d[2]


def test_moment_fit_counts_rates_once():
    mean, concentration = stats.moment_fit(np.array([5.0, 40.0, 90.0]), np.array([10.0, 100.0, 300.0]), np.ones(3))
    rates, pooled = np.array([0.5, 0.4, 0.3]), 135.5 / 411
    assert abs(mean - pooled) < 1e-12 and abs(concentration - (pooled * (1 - pooled) / ((rates - pooled) ** 2).mean() - 1)) < 1e-9
    assert 17 < concentration < 19


def test_runs_distribution():
    from itertools import combinations

    for a, b in ((3, 4), (2, 6), (1, 5)):
        tally = np.zeros(a + b - 1)
        for ones in combinations(range(a + b), a):
            x = np.isin(np.arange(a + b), ones)
            tally[1 + (x[1:] != x[:-1]).sum() - 2] += 1
        assert np.allclose(screens.runs_distribution(a, b), tally / tally.sum())
    assert abs(screens.runs_distribution(400, 700).sum() - 1) < 1e-9


def test_runs_screen_against_shuffles(spark):
    rng = np.random.default_rng(3)
    rows = [(m, p, s, "x" if (s // 4 % 2 if m == 0 else rng.random() < 0.5) else "y") for m in range(3) for p in range(4) for s in range(24)]
    df = spark.createDataFrame(rows, "m int, p int, s int, c string")
    got = {r.m: r for r in screens.runs_screen(df, "p", "m", "s", "c").collect()}

    def z_of(values):
        n, a = len(values), sum(values)
        e, v = 1 + 2 * a * (n - a) / n, 2 * a * (n - a) * (2 * a * (n - a) - n) / (n * n * (n - 1))
        return (1 + sum(x != y for x, y in zip(values, values[1:])) - e) / math.sqrt(v)

    blocks = {(m, p): [c == "x" for i, j, _, c in rows if (i, j) == (m, p)] for m in range(3) for p in range(4)}
    z = lambda b: [sum(z_of(b[m, p]) for p in range(4)) / 2 for m in range(3)]
    tops = np.array([max(map(abs, z({k: rng.permutation(v).tolist() for k, v in blocks.items()}))) for _ in range(1500)])
    for m, want in enumerate(z(blocks)):
        assert abs(got[m].z - want) < 1e-9 and abs(got[m].p - (1 + (tops >= abs(want)).sum()) / 1501) < 0.05
    assert got[0].p < 0.01
    with pytest.raises(ValueError, match="999"):
        screens.runs_screen(df, "p", "m", "s", "c", permutations=199)


def test_permutations_of_units(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "m", 1 + (i % 11) / 100, 1 + (i // 11) / 100, float(rng.normal()) + (6 if i in (0, 1, 11, 12) else 0)) for i in range(121)]
    df = spark.createDataFrame(rows, "u int, m string, lat double, lon double, r double")
    args = (df, "u", "m", "lat", "lon", "r")
    screen, joint = {r.u: r for r in screens.spatial_screen(*args).collect()}, {r.u: r for r in screens.joint_permutations(*args).collect()}
    links: dict = {}
    for r in screens.neighbours(df, "u", "m", "lat", "lon").collect():
        links.setdefault(r.u, []).append(r.other)
    x = np.array([r[4] for r in rows])
    z = x - x.mean()
    index = np.array([links[u] for u in range(121)])
    stat = lambda v: np.abs(v * v[index].mean(1) / (z**2).mean())
    drawn = np.array([stat(rng.permutation(z)) for _ in range(4000)])
    tops, seen = drawn.max(1), stat(z)
    for u in range(121):
        assert abs(joint[u].p - (1 + (drawn[:, u] >= seen[u]).sum()) / 4001) < 0.04
        assert abs(screen[u].p - (1 + (tops >= seen[u]).sum()) / 4001) < 0.05
    assert {r.permutations for r in joint.values()} == {99_999} and screen[0].flag and screen[0].kind == "cluster"
    assert [u for u, _ in sorted(screen.items(), key=lambda t: t[1]["rank"])] == sorted(screen, key=lambda u: (screen[u].p, u))
    with pytest.raises(ValueError, match="9,999"):
        screens.spatial_screen(*args, permutations=999)


def test_by_adjust_over_many_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 10 == 9 else f"f{i % 3}", i, None if i % 17 == 0 else float(rng.integers(1, 60)) / 100) for i in range(900)]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {r.id: (r["rank"], r.q) for r in windows.by_adjust(spark.createDataFrame(rows, "f string, id int, p double"), "f", "p", "id").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 900
    for f in {r[0] for r in rows}:
        family = sorted((p, i) for g, i, p in rows if g == f and p is not None)
        m = len(family)
        h = sum(1 / i for i in range(1, m + 1))
        least = 1.0
        for rank in range(m, 0, -1):
            p, i = family[rank - 1]
            least = min(least, p * m * h / rank)
            assert got[i][0] == rank and got[i][1] == pytest.approx(least, rel=1e-12)
    assert all(got[i] == (None, None) for _, i, p in rows if p is None)


def test_harmonic_numbers(spark):
    got = spark.createDataFrame([(1,), (10_000,), (10_001,), (2_000_000,)], "m long").select("m", windows.harmonic(F.col("m")).alias("h")).collect()
    for r in got:
        assert r.h == pytest.approx(math.fsum(1 / i for i in range(1, r.m + 1)), rel=1e-13)
