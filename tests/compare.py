"""Runs a registered query and its SQL on one test folder and compares rows, order ignored."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return str(v) if v is not None else None


def rows_of(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def check(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Asserts equality; the number of rows."""
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns), (df.columns, want.columns)
    a, b = rows_of(df.columns, df.collect()), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (len(bad), bad[:2])
    return len(a)
