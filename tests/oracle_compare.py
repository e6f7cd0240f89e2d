"""Run a query on Spark and its SQL on DuckDB and compare the rows as multisets."""

from __future__ import annotations

import collections
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return round(v, 4)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), collections.Counter(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark_df, con, sql):
    got_columns, got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    want_columns, want = rows([d[0] for d in res.description], res.fetchall())
    assert got_columns == want_columns
    missing, extra = want - got, got - want
    assert not missing and not extra, (
        f"{sum(got.values())} rows from Spark, {sum(want.values())} from SQL; "
        f"missing {sum(missing.values())} e.g. {list(missing)[:2]}, extra {sum(extra.values())} e.g. {list(extra)[:2]}")
    return sum(want.values())
