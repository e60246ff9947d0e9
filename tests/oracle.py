"""Comparison of a query's rows with DuckDB's for its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck_rows(sf: str, sql: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def value(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (int, float)) or hasattr(x, "is_normal"):
        return None if isinstance(x, float) and math.isnan(x) else float(x)
    return x if x is None else str(x)


def shaped(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(value(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(flat, key=lambda r: tuple((x is not None, str(type(x)), x if not isinstance(x, float) else round(x, 4)) for x in r))


def assert_same(df, sf: str, sql: str) -> int:
    names, got = shaped(df.columns, [tuple(r) for r in df.collect()])
    other, want = shaped(*duck_rows(sf, sql))
    assert names == other
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * (1 + abs(y)), (a, b)
    return len(got)
