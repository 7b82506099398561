"""All registered queries of the engine: name -> callable, and name -> equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answering, composites, parsing, relational, retrieval, upkeep

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries; each has QUERIES and ORACLE_SQL.
_MODULES: list = [retrieval, relational, composites, answering, parsing, upkeep]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.ORACLE_SQL
    return found
