"""All registered queries outside the language-model subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under ``name`` with its DuckDB counterpart, if SQL can express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from pagelens.plans import ledger_queries, log_queries, markup_queries, page_queries, state_queries, varied_queries, view_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return ORACLES
