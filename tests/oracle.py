"""Compares a query with its SQL, as sets of rows with multiplicity."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(df, con, sql):
    mine, other = df.toPandas(), con.execute(sql).df()
    cols = sorted(mine.columns)
    assert cols == sorted(other.columns)
    mine, other = (x[cols].sort_values(cols, ignore_index=True) for x in (mine, other))
    assert len(mine) == len(other)
    pd.testing.assert_frame_equal(mine, other, check_dtype=False, rtol=1e-9, atol=1e-9)
