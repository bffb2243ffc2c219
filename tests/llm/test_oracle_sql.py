"""Each registered query with SQL gives the rows that DuckDB gives (sf0.001, exact)."""

import duckdb
import pytest

from shelfwise.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = db.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
