"""Registering queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query; ``ctes`` stand before the SQL in a WITH clause (RECURSIVE, so any of them may recur)."""

    def add(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = ("with recursive " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add
