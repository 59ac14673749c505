"""The registered queries of the engine's own operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame, and its SQL if there is any."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from . import corpus, events, ingest, pages, relational, streams  # noqa: F401
