"""Compare a query with its SQL on the same tables."""

import decimal
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
            return "null"
        if isinstance(v, (decimal.Decimal, np.floating, float, np.integer, int, bool, np.bool_)):
            return f"{float(v):.6g}"
        if isinstance(v, pd.Timestamp):
            return str(v.tz_localize(None) if v.tzinfo else v)
        return str(v)

    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in row) for row in df[columns].itertuples(index=False, name=None))


def same(spark, con, folder, query, sql) -> None:
    got, wanted = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
