"""Comparison of queries with their SQL."""

import glob
import math
import os

import duckdb


def connect(d):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)


def sql_rows(c, sql):
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(norm(x[i]) for i in order) for x in r.fetchall()), key=str)
