"""Compares a query's rows with DuckDB's answer to its SQL, columns by name and rows in any order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    """Columns that differ, else rows in one answer only."""
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(names), sorted(df.columns))]
    want, got = rows_of(names, answer.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return []
    a, b = set(want) - set(got), set(got) - set(want)
    return [("rows", len(want), len(got)), ("only in SQL", sorted(a, key=repr)[:3]), ("only in Spark", sorted(b, key=repr)[:3])]
