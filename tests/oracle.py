"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows) -> list[tuple]:
    order = sorted(names)
    return sorted(tuple((v is None, str(v)) for v in (plain(dict(zip(names, r, strict=True))[n]) for n in order)) for r in rows)


def compare(spark, query, sql: str, folder: str = DATA) -> None:
    df = query(spark, folder)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(folder).sql(sql)
    wanted = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert found == wanted
