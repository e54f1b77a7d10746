"""All queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("metrics", "records", "serving", "incremental", "lifecycle", "validation", "contributing", "listing", "delivery", "claims", "figures", "gates", "support")


def _loaded():
    from importlib import import_module

    return [import_module(f"strideframe.plans.{name}") for name in _MODULES]


def queries() -> dict[str, Query]:
    return {name: query for module in _loaded() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _loaded() for name, sql in module.ORACLE.items()}
