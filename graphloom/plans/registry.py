"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import aggregates, change, graphs, greedy, indexes, joins, more, reads, search, streams, surface, tooling, trees  # noqa: F401  (registering)
from .base import QUERIES, SQL
from .shipping import shipped

FLAGSHIP = "A9_cochange"


def queries() -> dict:
    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
