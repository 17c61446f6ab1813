"""Streaming tables: buckets that a batch does not touch stay as they are, repeated batches change nothing."""

from __future__ import annotations

import pathlib
from datetime import datetime, timedelta

import pytest

from tallyloom.streaming import jobs

KIND = "k long, at long, v string"


def _state(target: pathlib.Path) -> dict:
    return {str(f.relative_to(target)): f.stat().st_mtime_ns for f in target.rglob("*.parquet")}


def _now(spark, target):
    return {r.k: (r["at"], r.v) for r in jobs.upserted(spark, str(target)).collect()}


def test_folding_batches(spark, tmp_path):
    target = tmp_path / "t"
    batches = [[(k, 1, "a") for k in range(100)], [(3, 2, "b"), (7, 0, "old"), (200, 5, "new")], [(3, 1, "late"), (200, 6, "c"), (200, 6, "d")]]
    want: dict = {}
    for number, rows in enumerate(batches):
        before, was = _state(target), (jobs._manifest(spark, str(target))[0] or {"live": {}})["live"]
        df = spark.createDataFrame(rows, KIND)
        jobs.fold(df, str(target), number, ["k"], ["at", "v"], buckets=16)
        for k, at, v in rows:
            want[k] = max(want.get(k, (-1, "")), (at, v))
        assert _now(spark, target) == want
        manifest, last = jobs._manifest(spark, str(target))
        assert last == number
        rewritten = {b for b, v in manifest["live"].items() if v == number}
        assert number == 0 or 0 < len(rewritten) <= 3
        whole = {f"v={v}/bucket_of_key={b}" for b, v in was.items() if b not in rewritten}
        kept = {f: t for f, t in before.items() if f.rsplit("/", 1)[0] in whole}
        assert kept.items() <= _state(target).items()
        jobs.fold(df, str(target), number, ["k"], ["at", "v"], buckets=16)  # the same batch again
        assert _now(spark, target) == want
    assert {f.split("/")[0] for f in _state(target)} <= {"v=0", "v=1", "v=2"}
    jobs.fold(spark.createDataFrame([(k, 9, "z") for k in range(300)], KIND), str(target), 3, ["k"], ["at", "v"], buckets=16)
    jobs.fold(spark.createDataFrame([(k, 10, "y") for k in range(300)], KIND), str(target), 4, ["k"], ["at", "v"], buckets=16)
    assert {f.split("/")[0] for f in _state(target)} == {"v=3", "v=4"} and len(_now(spark, target)) == 300  # old versions go
    with pytest.raises(ValueError, match="16 buckets"):
        jobs.fold(spark.createDataFrame([(1, 1, "a")], KIND), str(target), 5, ["k"], ["at", "v"], buckets=8)


def test_empty_batches(spark, tmp_path):
    none = spark.createDataFrame([], KIND)
    jobs.fold(none, str(tmp_path / "t"), 0, ["k"], ["at"])
    assert _now(spark, tmp_path / "t") == {}
    jobs.fold(spark.createDataFrame([(None, 1, "x"), (None, 2, "y")], KIND), str(tmp_path / "t"), 1, ["k"], ["at"])
    jobs.fold(none, str(tmp_path / "t"), 2, ["k"], ["at"])
    assert _now(spark, tmp_path / "t") == {None: (2, "y")}
    with pytest.raises(FileNotFoundError):
        jobs.upserted(spark, str(tmp_path / "nothing"))


def test_three_runs_of_a_stream(spark, tmp_path):
    source, target, want = tmp_path / "in", tmp_path / "t", {}
    for run in range(3):
        rows = [(k, run, f"{k}-{run}") for k in range(run * 5, run * 5 + 12)] + [(1000 + run, 0, "bad")]
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(KIND).parquet(str(source))
        jobs.upsert_latest(stream, str(target), ["k"], ["at"], str(tmp_path / "cp"), stream.v == "bad", str(tmp_path / "bad"), buckets=8).awaitTermination()
        want |= {k: (at, v) for k, at, v in rows if v != "bad"}
        assert _now(spark, target) == want and set(_now(spark, tmp_path / "bad")) == {1000 + r for r in range(run + 1)}


def test_versions_of_late_rows(spark, tmp_path):
    """Three runs: rows out of order, ties, null contents and keys; a row behind the watermark and one without a time are left out."""
    start, kind = datetime(2024, 3, 1), "key string, at timestamp, content string"
    at = lambda seconds, us=0: start + timedelta(seconds=seconds, microseconds=us)
    runs = [
        [("a", at(100), "x"), ("a", at(40), "y"), ("b", at(90), None), (None, at(5), "n"), ("a", None, "lost")],
        [("a", at(70), "x"), ("a", at(70, 300), "z"), ("a", at(100), "w"), ("b", at(80), "p"), ("b", at(200), None), (None, at(60), "n")],
        [("a", at(30), "behind"), ("a", at(150, 7), "x"), ("b", at(150), "q"), ("c", at(400), "end")],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    got = []
    for rows in runs:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        jobs.start_ordered(spark.readStream.schema(kind).parquet(source), "60 seconds", out, str(tmp_path / "cp")).awaitTermination()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
        got.append({(r.key, r["at"], r.content, r.version, r.revision) for r in spark.read.parquet(out).collect()})
    want, passed = set(), at(400) - timedelta(seconds=60)
    taken = [r for rows in runs for r in rows if r[1] is not None and r[1] <= passed and r[2] != "behind"]
    for key in {r[0] for r in taken}:
        last, number = object(), 0
        for _, t, c in sorted((r for r in taken if r[0] == key), key=lambda r: (r[1], r[2] is not None, r[2] or "")):
            if c != last:
                last, number = c, number + 1
                want.add((key, t, c, number, "first" if number == 1 else "revision"))
    assert got[-1] == want and got[0] < got[1] < got[2]
    assert ("a", at(70, 300), "z", 3, "revision") in want and not any(r[2] == "end" for r in want)


def test_no_rows_to_version(spark, tmp_path):
    kind = "key string, at timestamp, content string"
    spark.createDataFrame([(None, None, None)], kind).write.parquet(str(tmp_path / "in"))
    jobs.start_ordered(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "1 minute", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.schema(jobs.SNAPSHOT).parquet(str(tmp_path / "out")).count() == 0
