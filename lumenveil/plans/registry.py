"""The register of queries and their oracles; modules of ``plans`` add to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenveil.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle if it has one.

    recursive: the oracle has a CTE that refers to itself.
    """

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = with_views(sql).replace("WITH ", "WITH RECURSIVE ", 1) if recursive else with_views(sql)
        return run

    return add
