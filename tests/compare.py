"""Compares a registered query with its oracle SQL: names, row count and order-insensitive values."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return plain_float(float(v))
    if isinstance(v, float):
        return plain_float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def plain_float(v: float):
    return "nan" if math.isnan(v) else float(f"{v:.10g}")


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    rel = con.sql(sql)
    want_cols, want = list(rel.columns), rel.fetchall()
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    if sorted(want_cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} instead of {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a != b:
        only_a, only_b = a - b, b - a
        return (
            f"{len(got)} rows against {len(want)}; {sum(only_a.values())} differ over {sorted(got_cols)}\n"
            f"  spark : {sorted(map(str, only_a))[:3]}\n  oracle: {sorted(map(str, only_b))[:3]}"
        )
    return None
