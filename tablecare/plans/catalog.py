"""Registry of queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that gives the same rows where there is one."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL, importing the modules that define them."""
    from tablecare.plans import (  # noqa: F401
        cleaning_queries, metadata_queries, personal_queries, profile_queries, streaming_queries,
    )

    return QUERIES, ORACLES
