"""Spark rows against DuckDB rows, by column name and in any order."""

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rows(frame):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, str):
            return x
        return pd.Timestamp(x).tz_localize(None).isoformat() if hasattr(x, "year") else float(x)

    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def oracle(sql, folder=SMALL):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.sql(sql).df()


def same(df, sql, folder=SMALL):
    got, want = df.toPandas(), oracle(sql, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
