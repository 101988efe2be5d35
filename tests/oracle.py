"""Running a query next to its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, int):
        return float(v)
    return str(v)


def difference(df, sql: str, sf_dir: str) -> str | None:
    """What differs in columns or rows, order aside."""
    rel = connect(sf_dir).sql(sql)
    cols = sorted(rel.columns)
    if sorted(df.columns) != cols:
        return f"columns {sorted(df.columns)} != {cols}"
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if got == want:
        return None
    return f"{sum(got.values())} rows, {sum(want.values())} wanted; only got {list((got - want).items())[:3]}, only wanted {list((want - got).items())[:3]}"
