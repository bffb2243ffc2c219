"""P2 scope: the latest date is global, the category/store filter applies after it."""

import pytest

from conftest import sf_dir
from shelfwise.operators import products as P
from shelfwise.plans.catalog import enriched
from shelfwise.plans.oracle import ENRICH_CTES
from shelfwise.plans.verify import duckdb_connection

SF = sf_dir("0.01")


@pytest.fixture(scope="module")
def df(spark):
    d = enriched(spark, SF).cache()
    yield d
    d.unpersist()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


def _sql(con, body):
    return con.execute(f"WITH {ENRICH_CTES} {body}").fetchall()


@pytest.mark.parametrize("category,store", [("Toys", None), (None, "ASIA"), ("Clothing", "EUROPE"),
                                            ("Toys", "NOWHERE")])
def test_scoped_snapshot_kpis(df, con, category, store):
    conds = ["obs_date = (SELECT max(obs_date) FROM enr)"]
    if category:
        conds.append(f"category = '{category}'")
    if store:
        conds.append(f"store_id = '{store}'")
    want = _sql(con, f"""SELECT count(*), count(DISTINCT product_id), COALESCE(SUM(inventory_level), 0)
                         FROM enr WHERE {' AND '.join(conds)}""")[0]
    got = P.snapshot_kpis(df, category, store).first()
    assert (got.snapshot_rows, got.product_count, got.total_stock) == tuple(want)
    top = P.top_sellers(df, n=3, category=category, store=store).collect()
    assert len(top) == min(3, want[0])
    if category:
        assert all(r.category == category for r in top)


def test_history_gate_uses_full_history_in_scope(df, con):
    got = {r.product_id: r.history_rows
           for r in P.product_history_counts(df, category="Toys", store="ASIA").collect()}
    want = dict(_sql(con, """SELECT product_id, count(*) FROM enr
                             WHERE category = 'Toys' AND store_id = 'ASIA'
                             GROUP BY product_id HAVING count(*) >= 2"""))
    assert got == want
