"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(df: pd.DataFrame):
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = plain(QUERIES[name](spark, sf_dir).toPandas())
    if name in ORACLE_SQL:
        assert got == plain(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
