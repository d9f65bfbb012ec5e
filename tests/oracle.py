"""Compares a query with its DuckDB SQL."""

import math

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def assert_same(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    df, want = query(spark, data), con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
    return got
