"""Compares a query's rows with its SQL in DuckDB, whatever their order."""

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, float) and math.isnan(x):
        return "None"
    return repr(float(x)) if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio") else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def check(spark, sf_dir, query, sql):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = query(spark, sf_dir)
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, cursor.fetchall())
