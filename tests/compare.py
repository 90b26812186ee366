"""Results of a query and of its SQL twin as sorted rows of plain values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in at], sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    return ordered([d[0] for d in cursor.description], cursor.fetchall())


def spark_rows(df):
    return ordered(df.columns, [tuple(r) for r in df.collect()])
