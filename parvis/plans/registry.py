"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query under the function's name."""
    QUERIES[f.__name__] = f
    return f


def oracle(name: str, sql: str) -> None:
    """Registers the SQL that gives the same rows."""
    ORACLES[name] = sql
