"""Runs a query and its SQL over the same tables and compares the rows."""

import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.8g}"
    return str([value(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


def duck(folder=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(value(r[n]) for n in names) for r in df.collect()), key=str)


def rows_of_duck(con, sql):
    r = con.execute(sql)
    have = [d[0] for d in r.description]
    at = [have.index(n) for n in sorted(have)]
    return sorted(have), sorted((tuple(value(x[i]) for i in at) for x in r.fetchall()), key=str)
