"""Compare a registered query with its oracle, column by column, order ignored."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value == int(value) and abs(value) < 1e15 else repr(value))
    if isinstance(value, (datetime, date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def compare(con, sql: str, df) -> str | None:
    """None when equal, else a short description of the first difference."""
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    want_rows = want.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    want_rows = _rows(names, want_rows)
    if len(got) != len(want_rows):
        return f"{len(got)} rows, oracle {len(want_rows)}"
    for a, b in zip(got, want_rows):
        if a != b:
            return f"{a!r:.300} != {b!r:.300}"
    return None
