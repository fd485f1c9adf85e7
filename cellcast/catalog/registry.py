"""Registration of queries and their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellcast.catalog.views import Tables, with_views

Query = Callable[[SparkSession, str], DataFrame]
SECTIONS = ("sources", "scalars", "joins", "aggregates", "windows", "polygons", "sampling",
            "models", "evaluation", "extras", "plans")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: str = ""):
    """Register ``f(tables) -> DataFrame``; the oracle is prefixed with the named views as CTEs."""
    def register(f: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            _ORACLES[name] = with_views(oracle, views.split())
        return f

    return register


def _load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"cellcast.catalog.{section}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
