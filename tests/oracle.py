"""Comparison of a query with its DuckDB SQL, as unordered rows of equal columns."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def same(df, con, sql):
    names = sorted(df.columns)
    ours = sorted((repr([plain(r[c]) for c in names]) for r in df.collect()))
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in found.fetchall())
    assert ours == theirs
