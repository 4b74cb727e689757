"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from testbed import duck
from testbed.views import Roles, for_duckdb, with_roles

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TODAY = "2001-09-01"


def query(name: str, sql: str | None = None):
    """Register fn(roles) -> DataFrame, with the DuckDB query that must agree."""
    def add(fn):
        def run(spark, sf_dir):
            return fn(Roles(spark, sf_dir))
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def oracles() -> dict[str, str]:
    """Oracle text with its WITH clause; built late, when every table is known."""
    return {name: for_duckdb(with_roles(sql, duck.TABLES, "AS MATERIALIZED")) for name, sql in ORACLES.items()}
