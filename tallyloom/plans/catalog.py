"""All registered queries and the SQL that they must match."""

from __future__ import annotations

from tallyloom.plans import base, comparisons, describing, details, feeds, records, releases, rollups  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
