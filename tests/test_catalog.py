"""Every query with SQL gives the SQL's rows; the others give rows."""

import duckdb
import pandas as pd
import pytest

from snipspark import catalog, catalog_code  # noqa: F401  (the second adds its queries to the first)

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    value = lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name not in catalog.ORACLE:
        assert len(got)
        return
    want = db.execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
