"""Every registered query against its SQL; queries without SQL against properties."""

from __future__ import annotations

import numpy as np
import pytest
from compare import check
from conftest import SF

from tallyloom.operators import quality, screens
from tallyloom.plans import catalog

SMALL = SF.replace("sf0.01", "sf0.001")


@pytest.fixture(scope="module")
def small():
    from compare import duck

    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, small, name):
    check(catalog.queries()[name](spark, SMALL), small, catalog.oracle_sql()[name])


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(catalog.queries()) <= set(e.queries())


def test_screens_return_every_unit(spark):
    q = catalog.queries()
    n = q["long_metrics"](spark, SMALL).where("metric = 'share'").count()
    for name in ("peer_screen", "peer_screen_moments"):
        rows = q[name](spark, SMALL).collect()
        assert len(rows) == n
        for r in rows:
            assert (r.p is None) == (r.reason is not None) and r.signal is False
            assert r.p is None or 0 <= r.p <= 1 and r.p <= r.q + 1e-12
    assert q["hierarchical_reference"](spark, SMALL).count() == n


def test_permutation_screens_repeat(spark):
    runs = catalog.queries()["runs_screen"]
    a, b = (sorted(map(str, runs(spark, SMALL).collect())) for _ in range(2))
    assert a == b and a
    assert all(0 < r.p <= 1 for r in runs(spark, SMALL).collect())


def test_spatial_screens_test_units(spark):
    """On sf0.01 every exclusion but a small municipality's occurs, there are tested units, and a second run gives the same."""
    screen = catalog.queries()["spatial_screen"]
    a, b = ({r.row: r for r in screen(spark, SF).collect()} for _ in range(2))
    assert a == b and len(a) == spark.read.parquet(f"{SF}/orders.parquet").count()
    tested = [r for r in a.values() if r.reason is None]
    assert len(tested) > 500 and all(0 < r.p <= 1 for r in tested) and sorted(r["rank"] for r in tested) == list(range(1, len(tested) + 1))
    assert set(screens.EXCLUSIONS[:5]) <= {r.reason for r in a.values()}
    joint = catalog.queries()["joint_permutations"](spark, SF).collect()
    assert len(joint) == len(tested) and all(0 < r.p <= 1 and r.permutations in (9_999, 99_999) for r in joint)


def test_json_shapes(spark):
    rows = catalog.queries()["json_shapes"](spark, SMALL).collect()
    assert sum(r["count"] for r in rows) == spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert all(r.shape for r in rows) and np.isfinite(len(rows))


def test_every_broken_relation_is_found(spark):
    found = {r.finding for r in catalog.queries()["relation_findings"](spark, SF).select("finding").distinct().collect()}
    assert found == {"unknown_geography", "wrong_level", "no_unit", "unit_above_its_level", "unknown_unit", "no_fact", "orphan"}


def test_relations_of_empty_and_null_rows(spark):
    empty = [spark.createDataFrame([], k) for k in ("r long, id string, level string, parent_id string", "r long, id string", "r long, id string, geography_id string, geography_level string, unit_id string", "r long, fact_id string")]
    assert quality.relation_findings(*empty, ["r"], "unit").count() == 0
    facts = spark.createDataFrame([(1, "f", None, "unit", None), (1, "g", "p", "unit", "u"), (2, "g", "p", "unit", "u")], empty[2].schema)
    places = spark.createDataFrame([(1, "p", "unit", None), (1, "p", "unit", None)], empty[0].schema)
    got = quality.relation_findings(places, spark.createDataFrame([(1, "u")], empty[1].schema), facts, spark.createDataFrame([(1, "f"), (1, None), (2, "f")], empty[3].schema), ["r"], "unit")
    assert sorted((r.r, r.record, r.id or "", r.finding) for r in got.collect()) == [(1, "category", "", "no_fact"), (1, "fact", "f", "unknown_geography"), (2, "category", "f", "no_fact"), (2, "fact", "g", "unknown_geography"), (2, "fact", "g", "unknown_unit")]


def test_research_signals_are_the_planted_units(spark, con):
    assert check(catalog.queries()["research_signals"](spark, SF), con, catalog.oracle_sql()["research_signals"]) > 10
