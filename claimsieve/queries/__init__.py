"""All registered queries with SQL of the same meaning where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("scalar", "windows", "rules", "variants", "features", "network", "learning", "risk", "work")


def _entries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"claimsieve.queries.{m}").ENTRIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _entries().items() if sql}
