"""Registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from leafmill.plans.queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
