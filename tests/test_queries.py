"""Every query of the library that has SQL, held against it on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(df):
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    return sorted(map(tuple, df.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_agrees_with_its_sql(spark, duck, name):
    got, wanted = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    got, wanted = got[sorted(got.columns)], wanted[sorted(got.columns)]
    by = list(got.columns)
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True), wanted.sort_values(by).reset_index(drop=True), check_dtype=False, check_exact=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
