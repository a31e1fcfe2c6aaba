"""Runs a query on Spark and its SQL twin on DuckDB and compares rows, column by column in name order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

from modelward.sources.workload import BASE


def connect(folder: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, Decimal)):
        v = float(v) + 0.0
        return repr(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, sql: str, con) -> str:
    """Empty when both agree, else the first difference."""
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; got {got[:2]} expected {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"got {g} expected {w}"
    return ""
