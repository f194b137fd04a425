"""Names of all queries, what builds them, and the SQL their results are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql may name the adapters of plans.oracle as tables."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_parts(sql)
        return run

    return add
