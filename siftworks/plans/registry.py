"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES = ["scans", "findings", "joins", "summaries", "blocks", "history", "documents", "streams", "changes"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL where that can express it."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"siftworks.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: findings of the line rules over derived source files, by rule and severity."""
    _load()
    return _QUERIES["b1_rule_scan"](spark, sf_dir).groupBy("rule", "severity").count()
