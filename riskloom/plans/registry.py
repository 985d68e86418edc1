"""Where queries and their SQL equivalents are registered, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is a SELECT over the common table expressions of ``fixtures.SQL`` and ``ctes``."""
    from riskloom.plans.fixtures import SQL

    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"{SQL}{', ' + ctes if ctes else ''}\n{sql}"
        return f

    return keep
