"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from corvane import llm


def _modules() -> list:
    return [importlib.import_module(f"corvane.llm.{m.name}") for m in sorted(pkgutil.iter_modules(llm.__path__), key=lambda m: m.name) if m.name.startswith("op")]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
