"""Runs a registered query and its SQL side by side."""

import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


def views(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted([plain(r[c]) for c in cols] for r in df.collect())


def sql_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    return cols, sorted([plain(r[names.index(c)]) for c in cols] for r in got.fetchall())
