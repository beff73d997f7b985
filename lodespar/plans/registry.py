"""All queries of the library proper, by name, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("kv", "dup", "txn", "tpcc", "orderentry", "ycsb", "index", "telemetry", "stream")

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its own name; ``sql``: DuckDB's text for the same rows."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracle[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for x in MODULES:
        importlib.import_module(f"lodespar.plans.{x}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)
