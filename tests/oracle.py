"""Compares a registered query with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    text = lambda x: "NULL" if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(text(x) for x in r) for r in df.itertuples(index=False))


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c.execute(sql).df()


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), duck(sf_dir, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
