"""The driver's queries and their DuckDB equivalents, over tables derived from the driver's Parquet files."""

from __future__ import annotations

import importlib

MODULES = ("parsing", "reading", "correlating", "detecting", "keeping", "scalars", "streams")


def all_queries():
    """(queries, oracle SQL) of all modules."""
    from checks.registry import ORACLE, QUERIES

    for name in MODULES:
        importlib.import_module(f"checks.{name}")
    return QUERIES, ORACLE
