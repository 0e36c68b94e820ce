"""Holds a query's rows against DuckDB's."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str = SMALL):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, np.generic):
        return plain(v.item())
    if isinstance(v, float):
        return round(v, 5)
    return v


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


def same(spark, query, sql, sf_dir: str = SMALL):
    mine, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
