"""Comparison of a Spark result with DuckDB's, without regard to order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same(df, sf_dir, sql):
    names = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    columns, rows = duck(sf_dir, sql)
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert mine == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)
