"""Every core query with SQL against DuckDB, the others for rows, on the smallest tables."""

import os

import duckdb
import pytest

from meshlark.plans import catalogue

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (got, want))
    for c in columns:
        assert got[c].tolist() == want[c].tolist()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
