"""The query registry: name -> callable, and name -> DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under a name, with its oracle if there is one."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            # queries round with the same shift: see queries_market.r
            _ORACLES[name] = re.sub(r"\bround\(", "round(1e-9 + ", sql)
        return fn

    return add


MODULES = ["queries_market", "queries_intraday", "queries_company", "queries_trading", "queries_core"]


def _load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"lakeloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import queries_market

    return queries_market.flagship(spark, sf_dir)
