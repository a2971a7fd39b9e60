"""Rows of a query against rows of its oracle, in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = con.sql(sql)
    columns = sorted(got.columns)
    return columns, norm(got.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def query_rows(df):
    columns = sorted(df.columns)
    return columns, norm(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
