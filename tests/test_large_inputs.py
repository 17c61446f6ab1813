"""Steps that larger inputs broke: what is written and shuffled, and SQL that only fitted small data."""

from __future__ import annotations

import pathlib
import re
import tempfile
import time

import numpy as np
import pandas as pd
import pytest
from compare import duck
from conftest import SF
from pyspark.sql import functions as F

from tallyloom import scratch
from tallyloom.operators import composition, quality, reconcile, screens, trees, windows
from tallyloom.plans import base, catalog
from tallyloom.sources import counts
from tallyloom.streaming import jobs

SMALL = SF.replace("sf0.01", "sf0.001")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Rows and types of all tables that tree walks write."""
    seen = []

    def kept(df, name, real=trees.kept):
        out = real(df, name)
        seen.append((out.count(), [t for _, t in out.dtypes]))
        return out

    for module in (trees, windows):
        monkeypatch.setattr(module, "kept", kept)
    return seen


def _chain(spark, n):
    return spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id long, parent_id long")


def test_paths_are_written_in_parts(spark, written):
    """the table of all ancestors, here 820 rows, is never written."""
    got = trees.paths(_chain(spark, 40)).collect()
    assert sorted((r.id, r.depth, r.ancestor) for r in got) == [(i, k, k) for i in range(40) for k in range(i + 1)]
    assert max(n for n, _ in written) <= 40 * 41 // 2 // trees.NEAR + 40


def test_paths_write_each_id_once(spark, monkeypatch):
    """F2 of round 4: rows of a walk hold an id once, not with each of the nodes below it."""
    held = []

    def kept(df, name, real=trees.kept):
        out = real(df, name)
        held.extend(out.agg(F.sum(F.size(c))).first()[0] or 0 for c, t in out.dtypes if t.startswith("array"))
        return out

    monkeypatch.setattr(trees, "kept", kept)
    assert trees.paths(_chain(spark, 200)).count() == 200 * 201 // 2
    assert sum(held) <= 200


@pytest.mark.parametrize("asked", [False, True])
def test_paths_over_pieces(spark, monkeypatch, asked):
    """F2 of round 4: long lines, lines that leave others anywhere, many children, cycles and what hangs below them."""
    rng = np.random.default_rng(6)
    up = {i: i - 1 if i else None for i in range(30)} | {i: int(rng.integers(i)) for i in range(30, 90)} | {i: None if i % 10 == 0 else i - 10 for i in range(90, 130)}
    up |= {i: 95 for i in range(130, 150)} | {200: 202, 201: 200, 202: 201, 203: 200, 204: 203, 205: 204, 206: 206, 300: 999}
    monkeypatch.setattr(trees, "NEAR", 3)
    want = set()
    for i in up:
        way = [i]
        while up.get(way[-1]) in up and len(way) < 300:
            way.append(up[way[-1]])
        if len(way) < 300 and not (asked and i % 3):
            want |= {(i, len(way) - 1 - k, a) for k, a in enumerate(way)}
    df = spark.createDataFrame(list(up.items()), "id long, parent_id long")
    got = [tuple(r) for r in trees.paths(df, of=F.col("id") % 3 == 0 if asked else None).select("id", "depth", "ancestor").collect()]
    assert len(got) == len(want) and set(got) == want


def test_what_is_written_leaves_no_shuffle_files(spark, monkeypatch):
    """F2 of round 4: files of a shuffle go once its table is written, and the session's own setting stays."""
    shuffled = lambda: {f for f in pathlib.Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data")}
    spark.conf.unset(scratch.CLEANED)
    before = shuffled()
    out = scratch.kept(spark.range(1000).repartition(7, "id"), "numbers")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and out.count() == 1000 and spark.conf.get(scratch.CLEANED, None) in (None, "false")
    spark.range(1000).repartition(7, "id").write.format("noop").mode("overwrite").save()
    assert shuffled() - before  # where they are looked for


def test_nested_sets_write_no_paths(spark, written):
    """a row a node, no arrays."""
    got = {r.id: (r.tree_left, r.tree_right) for r in windows.nested_sets_by_links(_chain(spark, 40)).collect()}
    assert got == {i: (i + 1, 80 - i) for i in range(40)}
    assert all(n <= 40 and not any("array" in t for t in types) for n, types in written)


def test_walks_write_numbers(spark, written):
    """after the two tables of ids, rounds write numbers only."""
    tree = spark.createDataFrame([(f"n{i:02}", f"n{i - 1:02}" if i else None) for i in range(40)], "id string, parent_id string")
    assert {r.id: r.depth for r in trees.descend(tree, "n07").collect()} == {f"n{i:02}": i - 7 for i in range(7, 40)}
    assert sum("string" in types for _, types in written) <= 2


def test_quantiles_without_a_group_in_one_task(spark):
    """no percentile buffers; null groups, null ratios and ties count as before."""
    rng = np.random.default_rng(1)
    values = [(s, float(v) if v < 40 else None) for s in ("a", "b", None) for v in rng.integers(0, 50, 101)]
    df = spark.createDataFrame([*values, ("empty", None)], "s string, r double")
    out = composition.variant_summaries({"all": df, "low": df.where("r < 10")}, "r", ["s"], [1.5])
    assert "percentile" not in _plan(out).lower()
    got = {(r.variant, r.s): r for r in out.collect()}
    assert len(got) == 7 and got["all", "empty"].median_ratio is None and got["all", "empty"].rows == 1 and got["all", "empty"].above_1_5 == 0
    for s in ("a", "b", None):
        x = np.array([v for k, v in values if k == s and v is not None])
        r = got["all", s]
        assert (r.rows, r.with_ratio, r.min_ratio, r.max_ratio, r.above_1_5) == (101, len(x), x.min(), x.max(), (x > 1.5).sum())
        assert abs(r.median_ratio - np.quantile(x, 0.5)) < 1e-9 and abs(r.p95_ratio - np.quantile(x, 0.95)) < 1e-9


def test_pairs_of_records_are_made_last(spark, monkeypatch):
    """no pair is shuffled or grouped; records of one class over several lists, null and empty atoms."""
    monkeypatch.setattr(reconcile, "MEMBERS", 2)
    rows = [(i, ["x", "y"] if i < 300 else ["y", "z", "z"] if i < 310 else [None] if i < 320 else []) for i in range(330)]
    df = reconcile.overlapping_records(spark.createDataFrame(rows, "id long, atoms array<string>"), "id", "atoms")
    assert "Aggregate" not in _plan(df).split("Exchange")[0]
    want = {(a, b): 2 if b < 300 or a >= 300 else 1 for a in range(310) for b in range(a + 1, 310)}
    got = df.collect()
    assert len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want


def test_a_place_with_units_but_no_facts_has_no_result(tmp_path):
    """the SQL says what the query and the reference say, a missing result, not a missing unit."""
    con = duck(SMALL)
    place = con.execute("SELECT min(o_custkey) FROM orders").fetchall()[0][0]
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet' WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = {place})")
    assert (place, "missing_result") in con.execute(catalog.oracle_sql()["anomalies"]).fetchall()


def test_tails_of_large_chi_squares():
    """5,000 equal digits give 45,000; the SQL's series stopped before its largest term."""
    con = duck(SMALL)
    con.execute("CREATE OR REPLACE VIEW customer AS SELECT 1 AS c_custkey, 1 AS c_nationkey")
    con.execute("CREATE OR REPLACE VIEW orders AS SELECT i AS o_orderkey, 1 AS o_custkey, TIMESTAMP '1995-01-01' AS o_orderdate, 1.0 AS o_totalprice FROM range(5000) AS t(i)")
    con.execute("CREATE OR REPLACE VIEW lineitem AS SELECT i AS l_orderkey, 1 AS l_linenumber, 10.0 AS l_quantity, 'A' AS l_returnflag, 'F' AS l_linestatus FROM range(5000) AS t(i)")
    assert sorted(con.execute(catalog.oracle_sql()["last_digit_tails"]).fetchall()) == [("*", 45000.0, 0.0, True), ("AF", 45000.0, 0.0, True)]


@pytest.mark.parametrize("name", ["source_arithmetic", "result_arithmetic"])
def test_categories_side_by_side_in_one_aggregation(spark, name):
    """no pivot, and the totals are not joined to what they are totals of."""
    plan = _plan(catalog.queries()[name](spark, SMALL))
    assert "pivot" not in plan.lower() and plan.count("lineitem") <= plan.count("FileScan") and plan.count("l_quantity") and plan.count("lineitem.parquet") == 1


def test_vectors_without_pivot(spark):
    """F22."""
    facts = spark.createDataFrame([(1, "A", 2), (1, "A", 3), (2, "B", None), (4, "A", 1)], "u long, c string, v long")
    df = composition.densify(facts, "u", "c", ["A", "B"], "v", spark.createDataFrame([(1,), (2,), (3,)], "u long"))
    assert "pivot" not in _plan(df).lower() and sorted(map(tuple, df.collect())) == [(1, 1, 5, 0), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_layers_by_one_aggregation(spark):
    """counted and judged in one grouping; the facts are not joined with their own counts."""
    facts = spark.createDataFrame([("a", 1, "t", "l", False, None), ("a", 1, "t", "m", True, False), ("x", 2, None, "l", None, True)], "source string, unit long, source_type string, legal_status string, inferred boolean, ambiguous boolean")
    df = quality.fact_layers(facts, spark.createDataFrame([("a", "t", "l")], "source string, source_type string, legal_status string"), "source", ["unit"], {"t": "l"})
    assert _plan(df).count("Join") == 1
    assert sorted(map(tuple, df.collect())) == [("a", 1, "duplicate"), ("a", 1, "illegal_status"), ("a", 1, "inferred"), ("a", 1, "legal_status_mismatch"), ("x", 2, "ambiguous"), ("x", 2, "illegal_status"), ("x", 2, "unknown_source")]


def test_tails_of_equal_states_stand_together(spark):
    """rows are dealt by state and sorted before the tails, not by pool."""
    df = spark.createDataFrame([(i, i % 3, 90, 0.1, 20.0) for i in range(9)], "unit long, y long, n long, m double, c double")
    out = screens._scored(df, "y", "n", "m", "c")
    below = _plan(out).split("ArrowEvalPython", 1)[1]
    assert "Sort [y" in below and "hashpartitioning(y" in below
    rows = out.collect()
    assert len(rows) == 9 and len({(r.y, r.p) for r in rows}) == 3


def test_reconciliation_by_unit(spark):
    """F8: no join of layers or distinct values; copies, lost values, null units and categories as `compare_sources` has them."""
    rows = [("a", 1, "x", 2), ("b", 1, "x", 2), ("a", 2, "x", 2), ("a", 2, "x", 2), ("b", 2, "x", 2), ("a", 3, "x", 2), ("a", 3, "x", 4), ("b", 3, "x", 3), ("a", 4, "x", None), ("b", 4, "x", 1), ("a", 5, None, 1), ("b", 5, None, 1), ("a", None, "x", 1), ("b", None, "x", 1), ("b", 6, "y", 1), ("c", 6, "y", 9), (None, 1, "x", 1)]
    records = spark.createDataFrame(rows, "source string, unit long, category string, votes long")
    expected = spark.createDataFrame([(1,), (1,), (4,), (7,), (None,)], "unit long")
    df = reconcile.reconcile(expected, records, "source", "unit", "category", "votes", "a", "b")
    assert "FullOuter" not in _plan(df) and "distinct" not in _plan(df)
    got = {(r.check, r.source, r.state): r.n for r in df.collect()}
    pairs = reconcile.compare_sources(records, "source", "a", "b", ["unit"], "category", "votes").collect()
    states = ["not_comparable" if not r.comparable else "equal" if r.difference == r.min_edits == 0 else "different" for r in pairs]
    assert {s: n for (c, _, s), n in got.items() if c == "comparison"} == {s: states.count(s) for s in states} == {"equal": 2, "different": 1, "not_comparable": 3}
    assert {k[1:]: n for k, n in got.items() if k[0] == "identity"} == {("a", "duplicate"): 1, ("a", "conflict"): 1}
    plain = reconcile.completeness_by_source(expected, records.groupBy("source", "unit").agg(F.bool_or(F.col("votes").isNull()).alias("lost")), "source", ["unit"], "lost").collect()
    assert {k[1:]: n for k, n in got.items() if k[0] == "completeness"} == {(r.source, r.state): r.units for r in plain}


def test_lines_are_dealt_by_order(spark, monkeypatch):
    """One shuffle of the lines by order, with tasks as the lines need; the session's number where that does."""
    assert base.by_order(spark, SMALL).rdd.getNumPartitions() <= 4
    monkeypatch.setattr(base, "LINES", 1000)
    n = -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 1000)
    assert n > 4 and base.by_order(spark, SMALL).rdd.getNumPartitions() == base.sources(spark, SMALL).rdd.getNumPartitions() == n
    assert "hashpartitioning(l_orderkey" in _plan(base.facts(spark, SMALL)) and "category" not in _plan(base.facts(spark, SMALL)).split("hashpartitioning(l_orderkey")[1].split("\n")[0]


def test_summary_has_no_row_for_each_unit(spark, monkeypatch):
    """one read of the lines, units counted where they were dealt, only sums written."""
    written = []
    monkeypatch.setattr(composition, "kept", lambda df, name, real=composition.kept: written.append((_plan(df), real(df, name))) or written[-1][1])
    monkeypatch.setattr(base, "LINES", 1000)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as for tables too large for it
    try:
        assert catalog.queries()["descriptive_summary"](spark, SMALL).where("section = 'units'").count() == 1
    finally:
        spark.conf.set(threshold, before)
    plan, table = written[0]
    assert table.count() <= 5 * (6 + 1) and plan.count("lineitem.parquet") == 1 and "Expand" not in plan and "hashpartitioning(u#" not in plan


def test_orders_are_dealt_by_customer(spark, monkeypatch):
    """where customers are too many to broadcast, the join has tasks as the orders need."""
    monkeypatch.setattr(base, "LINES", 100)
    n = -(-spark.read.parquet(f"{SMALL}/orders.parquet").count() // 100)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = _plan(base.units(spark, SMALL))
    finally:
        spark.conf.set(threshold, before)
    assert n > 4 and all(re.search(rf"hashpartitioning\({c}#\d+L?, {n}\)", plan) for c in ("o_custkey", "c_custkey"))


def test_summary_of_odd_rows(spark):
    """null units, candidates, families, states, departments and votes, units in several departments, copies, no rows."""
    rng = np.random.default_rng(5)
    pick = lambda *x: x[rng.integers(len(x))]
    rows = [(pick(None, *range(40)), pick(None, 1, 2), pick(None, "f", "g"), pick(None, "ok", "bad", "odd"), pick(None, "x", "y", "z"), pick(None, 1, 2, 3)) for _ in range(300)]
    rows += rows[:50] + [(7, 9, "h", "odd", "w", None)]
    schema = "u long, d long, f string, s string, c string, v long"
    summary = lambda r: sorted(map(str, map(tuple, composition.descriptive(spark.createDataFrame(r, schema), *"udfscv", ["ok", "bad"]).collect())))
    sums = lambda key: {k: sum(x) for k in {key(r) for r in rows} if (x := [r[5] for r in rows if key(r) == k and r[4] is not None and r[5] is not None])}
    by_c, by_dc = sums(lambda r: r[4]), sums(lambda r: (r[1], r[4]))
    top = sorted(by_c.values())[::-1]
    want = [("units", None, None, None, None, len({r[0] for r in rows} - {None}), None), ("margin", None, None, None, None, top[0] - top[1], None)]
    want += [("status", None, f, s, None, sum(r[2] == f and r[3] == s for r in rows), None) for f in "fgh" for s in ("ok", "bad")]
    want += [("candidate", None, None, None, c, v, v / sum(top)) for c, v in by_c.items()]
    want += [("department_candidate", None if d is None else str(d), None, None, c, v, None) for (d, c), v in by_dc.items()]
    assert len(by_c) == 3 and len(by_dc) == 9 and summary(rows) == sorted(map(str, want))
    assert summary([]) == [str(("units", None, None, None, None, 0, None))]


def test_shares_are_dealt_by_place(spark, monkeypatch):
    """the window of shares has tasks as the lines need."""
    monkeypatch.setattr(base, "LINES", 1000)
    n = -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 1000)
    assert catalog.queries()["rollup_levels"](spark, SMALL).rdd.getNumPartitions() == n


def test_count_documents_are_parsed_once(spark):
    """one pass; absent and null parts as before."""
    docs = [(1, '{"totals":{"t":"1"},"parties":[{"code":"p","votes":"n/a","candidates":[{"code":"c","votes":"2"},null]},null]}'), (2, '{"totals":{"t":null}}'), (3, '{"totals":{},"parties":[{"code":"q"}]}'), (4, None), (5, '{"parties":[]}')]
    good, bad = counts.count_documents(spark.createDataFrame(docs, "k int, raw string"), "raw", ["k"])
    assert _plan(good).count("from_json") == 1
    none = "unavailable"
    want = [(1, "t", None, None, "observed", 1), (1, "party", "p", None, none, None), (1, "candidate", "p", "c", "observed", 2), (1, "candidate", "p", None, none, None), (1, "party", None, None, none, None), (2, "t", None, None, none, None), (3, "party", "q", None, none, None)]
    assert sorted(map(str, map(tuple, good.select("k", "metric", "party", "candidate", "status", "value").collect()))) == sorted(map(str, want))
    assert sorted((r.k, r.reason) for r in bad.collect()) == [(4, "not_a_count_document"), (5, "not_a_count_document")]


def test_wide_download_without_pivot(spark):
    """F25."""
    df = counts.wide_download(spark.createDataFrame([(1, "A", 2), (1, "A", 3), (2, "B", 1), (3, "C", 4)], "u long, c string, v long"), ["u"], "c", "v", ["A", "B"])
    assert "pivot" not in _plan(df).lower() and df.columns == ["u", "candidate_A_votes", "candidate_B_votes"]
    assert sorted(map(str, map(tuple, df.collect()))) == ["(1, 3, None)", "(2, None, 1)", "(3, None, None)"]


def test_permutations_in_parts(monkeypatch):
    """what is drawn at once is bounded, and the parts are what one draw of the whole batch gives."""
    rng = np.random.default_rng(3)
    near = [sorted(rng.choice(90, 5, replace=False).tolist()) for _ in range(90)]
    pdf = pd.DataFrame({"group": 1, "unit": range(90), "residual": rng.random(90), "others": [np.array(x) for x in near], "tested": [i % 4 > 0 for i in range(90)], "start": 0, "size": 300, "batch": 256})
    drawn = []
    real = np.tile
    monkeypatch.setattr(np, "tile", lambda z, shape: drawn.append(len(z) * shape[0]) or real(z, shape))
    whole = screens._top_moran(pdf), screens._unit_moran(pdf)
    assert max(drawn) == 90 * 256
    drawn.clear()
    monkeypatch.setattr(screens, "DRAWN", 1000)
    parts = screens._top_moran(pdf), screens._unit_moran(pdf)
    assert max(drawn) <= 1000 and all(a.equals(b) for a, b in zip(whole, parts, strict=True))


def test_draws_are_read_in_place(monkeypatch):
    """F1 of round 4: no read of a draw copies all of it, also where a batch is no multiple of what is drawn at once."""
    rng = np.random.default_rng(3)
    near = [sorted(rng.choice(90, 5, replace=False).tolist()) for _ in range(90)]
    pdf = pd.DataFrame({"group": 1, "unit": range(90), "residual": rng.random(90), "others": [np.array(x) for x in near], "tested": True, "start": 0, "size": 300, "batch": 256})
    whole, read, real = screens._unit_moran(pdf), [], np.take

    def take(a, *args, out, **kw):
        read.append((a.flags.c_contiguous and out.flags.c_contiguous, a.shape[1]))
        return real(a, *args, out=out, **kw)

    monkeypatch.setattr(np, "take", take)
    monkeypatch.setattr(screens, "DRAWN", 1000)
    assert screens._unit_moran(pdf).equals(whole)
    assert {n for _, n in read} == {11, 256 % 11, 44 % 11} - {0} and all(ok for ok, _ in read)


def test_permutations_are_dealt_evenly(spark):
    """F1 of round 4: much to compute on few bytes gets more tasks than Spark's size rules give, little does not."""
    work = spark.createDataFrame([(i % 5, i, 0.0, [], True, "u") for i in range(20)], "group long, unit long, residual double, others array<long>, tested boolean, id string")
    many = screens._dealt(work, 9_999, 99_999, 256, 200_000, 5)
    assert many.rdd.getNumPartitions() == 440 and many.count() == 20 * 44 and many.select("group", "start").distinct().count() == 5 * 44
    assert many.agg(F.min("start"), F.max(F.col("start") + F.col("size"))).first() == (9_999, 99_999)
    assert "REPARTITION_BY_NUM" not in _plan(screens._dealt(work, 0, 9_999, 256, 20, 5)) and "REPARTITION_BY_NUM" in _plan(many)


@pytest.mark.parametrize("name", ["overlap_classes", "full_reconciliation", "release_documents"])
def test_records_are_made_once(spark, name):
    """What several checks read is written once, not made again from the lines or orders by each of them."""
    plan = _plan(catalog.queries()[name](spark, SMALL))
    assert "lineitem.parquet" not in plan and (name != "overlap_classes" or "orders.parquet" not in plan)


def test_runs_are_counted_once_and_their_distributions_kept(spark):
    """no join of a block's counts with each other; a distribution is made once a worker."""
    rows = [("p", 1, i, c) for i, c in enumerate("xyxxyyxy")] + [(None, 1, i, c) for i, c in enumerate("xyxxyy")] + [("q", 1, i, "x") for i in range(8)] + [("r", 1, i, c) for i, c in enumerate("xyzxyzxyz")]
    df = windows.runs_moments(spark.createDataFrame(rows, "place string, block long, seq long, c string"), ["place", "block"], "seq", "c")
    assert "Join" not in _plan(df) and [(r.place, r.n, r.runs, r.fewer) for r in df.collect()] == [("p", 8, 6, 4)]
    assert screens._runs_steps(4, 5) is screens._runs_steps(4, 5)


def test_a_key_without_changes_costs_no_frame():
    """versions in order of (at, content; nulls last) over several frames; no empty frame for a key that did not change."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, t = State(), pd.to_datetime(["2020-01-03", "2020-01-01", "2020-01-02", None])
    frames = [pd.DataFrame({"at": t[:2], "content": ["a", "b"]}), pd.DataFrame({"at": t[2:], "content": [None, "a"]})]
    (out,) = jobs._track(("k",), iter(frames), state)
    assert list(out.columns) == ["key", "at", "content", "version", "revision"]
    assert [(r.key, r.content if isinstance(r.content, str) else None, r.version, r.revision) for r in out.itertuples()] == [("k", "b", 1, "first"), ("k", None, 2, "revision"), ("k", "a", 3, "revision")]
    assert list(jobs._track(("k",), iter([pd.DataFrame({"at": t[:1], "content": ["a"]})]), state)) == []
