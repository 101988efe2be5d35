"""Names of the corpus queries and their SQL."""

from __future__ import annotations

from ..plans.shipping import shipped
from . import queries as q
from . import sql


def queries() -> dict:
    return {f: shipped(getattr(q, f)) for f in dir(q) if f.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
