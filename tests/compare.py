"""Run a query and its SQL and compare rows as multisets."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_cell(r[c]) for c in cols) for r in df.select(*cols).collect())


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
