"""Holds a Spark result against a DuckDB result."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str = DATA):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if not isinstance(x, (list, dict)) and pd.isna(x):
            return ""
        if hasattr(x, "isoformat"):
            return str(pd.Timestamp(x))
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    cols = sorted(df.columns)
    return sorted(tuple(plain(x.item() if hasattr(x, "item") else x) for x in row) for row in df[cols].itertuples(index=False, name=None))


def assert_same(spark_df, sql: str, con) -> None:
    got, want = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3] == []
