"""Every registered query: name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under name, with its SQL."""

    def put(f):
        _REGISTERED[name] = (f, sql)
        return f

    return put


_MODULES = ("timeseries", "tables", "graphs", "statistics", "kernels", "files")


def _loaded() -> dict:
    for m in _MODULES:
        importlib.import_module(f"tesselon.plans.{m}")
    return _REGISTERED


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _loaded().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _loaded().items() if s}
