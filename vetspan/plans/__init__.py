"""Named queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("reports", "texts", "messages", "commands", "attached", "assembly", "values")


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in import_module(f"{__name__}.{module}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in import_module(f"{__name__}.{module}").SQL.items()}
