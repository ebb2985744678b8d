"""Runs a query next to its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v.asDict().values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 3)
    return float(v) if isinstance(v, int) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in data)


def close(a: Counter, b: Counter) -> bool:
    """Equal, but for rounding in the last kept digit."""
    if a == b:
        return True
    left, right = sorted((a - b).elements(), key=repr), sorted((b - a).elements(), key=repr)
    if len(left) != len(right):
        return False
    near = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1.01e-3 + 1e-9 * abs(x))
    return all(all(near(x, y) for x, y in zip(p, q)) for p, q in zip(left, right))


def compare(spark, sf: str, query, sql: str):
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    expected = rows([d[0] for d in cursor.description], cursor.fetchall())
    return got, expected
