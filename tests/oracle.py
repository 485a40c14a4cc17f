"""Holds a query's rows against its SQL twin in DuckDB."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return round(float(x), 9) if isinstance(x, (int, float, np.number)) else x


def rows(df):
    return sorted(repr(tuple(map(_value, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def same(spark, con, sf_dir, query, sql):
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert a == b
