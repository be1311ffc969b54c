"""Registry of the named queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES: tuple[str, ...] = ("basics", "clustering", "sequences", "annealing", "curvature", "files", "control", "soft", "runs", "quality")


def _modules() -> list:
    from importlib import import_module

    return [import_module(f"pairforge.plans.{name}") for name in _MODULES]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= module.ORACLE_SQL
    return found
