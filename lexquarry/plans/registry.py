"""The queries of the core by name, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lexquarry.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where SQL can say it."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


for _module in ("search", "texts", "evidence", "drafts", "sections", "records", "tables"):
    import_module(f"lexquarry.plans.{_module}")
