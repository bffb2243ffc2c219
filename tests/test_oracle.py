"""Every SQL-checkable report equals its DuckDB oracle (sf 0.001, exact values)."""

import pytest

from conftest import sf_dir
from shelfwise.plans.catalog import MODEL_REPORTS, QUERIES
from shelfwise.plans.oracle import SQL
from shelfwise.plans.verify import compare, duckdb_connection

SF = sf_dir("0.001")
NAMES = [n for n in QUERIES if n in SQL]


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


def test_every_query_has_an_oracle_or_is_a_model():
    assert set(QUERIES) == set(SQL) | set(MODEL_REPORTS)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["ok"], r


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert set(e.oracle_sql()) <= set(e.queries())
