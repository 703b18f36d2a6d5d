"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return list(v) if isinstance(v, (list, tuple)) else v


def rows_of_sql(sf: str, sql: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.sql(sql)
    at = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return [r.columns[i] for i in at], sorted((tuple(_plain(row[i]) for i in at) for row in r.fetchall()), key=repr)


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
