"""Comparison of a query's rows with its DuckDB twin's."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def sql_rows(con, sql, columns):
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(columns), (names, columns)
    at = [names.index(c) for c in columns]
    return sorted(repr(tuple(normal(r[i]) for i in at)) for r in found.fetchall())


def spark_rows(df):
    return sorted(repr(tuple(normal(r[c]) for c in df.columns)) for r in df.collect())
