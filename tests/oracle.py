"""Comparing a Spark result with a DuckDB result as bags of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def order(row):
    return tuple((v is None, "" if v is None or isinstance(v, int | float) else str(v), v if isinstance(v, int | float) else 0) for v in row)


def compare(df, con, sql: str) -> None:
    names = sorted(df.columns)
    r = con.sql(sql)
    assert names == sorted(r.columns)
    kinds = dict(zip(r.columns, map(str, r.types), strict=True))
    assert {c: kinds[c] for c in names} == {c: KINDS.get(t, kinds[c]) for c, t in df.dtypes}
    at = [r.columns.index(c) for c in names]
    mine = sorted((tuple(plain(x[c]) for c in names) for x in df.select(names).collect()), key=order)
    theirs = sorted((tuple(plain(x[k]) for k in at) for x in r.fetchall()), key=order)
    assert mine == theirs
