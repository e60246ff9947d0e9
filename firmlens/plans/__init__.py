"""Registered queries of the library's operators over the relational and text tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import lists, lookups, scoring, serving, signals, streams, upkeep

_FAMILIES = (signals, scoring, serving, lists, lookups, upkeep, streams)


def queries() -> dict[str, Callable]:
    """Every query by name."""
    return {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses."""
    return {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
