"""The query catalogue: each module pairs Spark queries with their SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if not m.name.startswith("_")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {name: build for m in _modules() for name, build in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLES", {}).items()}
