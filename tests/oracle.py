"""Compare a Spark result with DuckDB's for the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return int(x)
    if hasattr(x, "as_tuple"):
        x = float(x)
    return round(x, 5) if isinstance(x, float) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def assert_same(df, sql: str, folder: str) -> None:
    got = df.collect()
    res = duck(folder).execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, res.fetchall())
    assert len(a) == len(b)
    assert a, "nothing was compared: both sides are empty"
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) <= 2e-5 * max(1, abs(v)), (x, y)
