"""Every query of the domain against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from emberfold import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda x: "~" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    assert got.columns
    if name in plans.ORACLE_SQL:
        assert plain(got.toPandas()) == plain(duck.execute(plans.ORACLE_SQL[name]).df())
    else:
        assert got.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
