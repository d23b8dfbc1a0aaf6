"""The registry that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.sources.tables import SQL as VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` may use the views of ``sources.tables``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            first = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
            SQL[f.__name__] = f"{first}{VIEWS}{', ' + body.removeprefix(first) if body.startswith('WITH ') else body}"
        return f

    return add
