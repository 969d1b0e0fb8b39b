"""Registry of (query, SQL) pairs."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netquarry.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("basics", "shapes", "audits", "kpis", "dumps", "sinks")


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(prepare(spark), folder)

        run.__name__ = name
        run.__doc__ = function.__doc__
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return register


def _load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"checks.{module}")


def all_queries() -> dict[str, Query]:
    _load_all()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
