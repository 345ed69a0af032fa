"""Queries of the comparison engine and their SQL oracles, gathered from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under name; sql is its DuckDB oracle, if SQL can express it."""

    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put


#: Modules that register queries when they are imported.
MODULES = ["texts", "policies", "rasters", "findings"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"folioscope.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
