"""Every registered query against its DuckDB oracle (row count, column names,
order-insensitive value hash), as the driver does."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import compare, duck
from touchline.oracle import oracle_sql
from touchline.plans.catalog import QUERIES

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF_SMALL), ORACLE[name], con)
    assert r["columns_match"], (r["spark_cols"], r["duck_cols"])
    assert r["rows"][0] == r["rows"][1]
    assert r["hash_match"]


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 0
    assert entry.entry(spark).columns == ["medium", "sessions"]
