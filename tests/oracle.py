"""Compares registered queries with their DuckDB SQL."""

import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.sql(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return c


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(spark, query, sql, folder):
    df = query(spark, folder)
    names = sorted(df.columns)
    found = connect(folder).sql(sql)
    assert sorted(found.columns) == names
    want = rounded(tuple(r[found.columns.index(n)] for n in names) for r in found.fetchall())
    got = rounded(tuple(r) for r in df.select(*names).collect())
    assert got == want
