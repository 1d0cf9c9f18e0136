"""Compares a query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, sql, sf_dir):
    want = connect(sf_dir).execute(sql)
    want_columns, want_rows = rows_of([d[0] for d in want.description], want.fetchall())
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert columns == want_columns
    assert len(rows) == len(want_rows), (len(rows), len(want_rows))
    wrong = [(a, b) for a, b in zip(rows, want_rows) if a != b]
    assert not wrong, wrong[:3]
    return len(rows)
