"""Comparison of a query with its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd

ROOT = "/root/testdata/sf0.001"


def connect(root=ROOT):
    c = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].map(lambda v: hasattr(v, "__len__") and not isinstance(v, str)).any():
            df[c] = df[c].map(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark, run, sql, root=ROOT):
    ours, theirs = run(spark, root).toPandas(), connect(root).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(normal(ours), normal(theirs), check_dtype=False, check_exact=True)
