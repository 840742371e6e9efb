"""Runs registered queries beside their SQL in DuckDB and compares rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) if abs(v) < 1e6 else float(f"{v:.10g}")
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    return v


def rows(columns: list[str], data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql: str) -> str:
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    odd = next((x for x in zip(got, want, strict=False) if x[0] != x[1]), None)
    return f"{len(got)} and {len(want)} rows; first difference {odd}"
