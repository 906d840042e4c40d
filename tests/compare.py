"""Rows of a query and of its oracle, made comparable."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9)) if v != int(v) else repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


def both(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    theirs = rows([c[0] for c in rel.description], rel.fetchall())
    return ours, theirs
