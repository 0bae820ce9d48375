"""Every query of the library (without the optional ``llm`` subpackage) and its DuckDB counterpart, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from stratafolio.plans import aggregates, decisions, geometry, headings, joins, lines, merging, outline, proposals, scalars, scans, tools, trees, units, validators, versions, windows  # noqa: E402, F401
