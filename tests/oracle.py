"""Run a query and its SQL, and compare them as multisets of rows."""

import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v if v is None else str(v)


def rows(columns, values):
    return sorted((tuple(plain(v) for v in r) for r in values), key=lambda r: tuple(x or "" for x in r))


def same(df, sql, sf):
    names = sorted(df.columns)
    got = rows(names, ([r[c] for c in names] for r in df.collect()))
    rel = connect(sf).sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == rows(names, ([r[i] for i in at] for r in rel.fetchall()))
