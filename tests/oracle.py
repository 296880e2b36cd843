"""Compare a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.sql(f"create view {t} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in records)


def check(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    made = con.sql(sql)
    assert sorted(made.columns) == sorted(df.columns)
    assert got == rows(made.columns, made.fetchall())
