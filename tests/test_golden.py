"""Golden figures of FIXTURES.md section 4 over the star-schema adapter."""

import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from shelfwise.operators import overview as H
from shelfwise.operators import procurement as L
from shelfwise.operators import products as P
from shelfwise.operators import suppliers as V
from shelfwise.plans.catalog import enriched

GOLDEN = {
    "0.001": dict(rows=6000, products=200, stores=5, vendors=10, health=(2064, 1716, 2220),
                  risk=1544, zero_sales=145, value=1358014089.80, lt_risk=3221,
                  latest=(2, 165, 79), urgency=(1040, 1151, 1650, 2014), half=0,
                  top=("Supplier#000000000", 87.6), tiers=(1, 3, 6)),
    "0.01": dict(rows=60000, products=2000, stores=5, vendors=100, health=(20715, 17293, 21992),
                 risk=15425, zero_sales=1150, value=14215315253.20, lt_risk=37124,
                 latest=(27, 6682, 660), urgency=(10372, 11676, 16691, 20111), half=46,
                 top=("Supplier#000000000", 93.4), tiers=(8, 17, 75)),
    "0.1": dict(rows=600000, products=20000, stores=5, vendors=1000,
                health=(206941, 173480, 219579), risk=152957, zero_sales=11908,
                value=142431732929.70, lt_risk=375530, latest=(248, 58747, 5743),
                urgency=(103221, 117286, 166628, 200957), half=426,
                top=("Supplier#000000210", 90.2), tiers=(72, 133, 795)),
}


@pytest.fixture(scope="module", params=sorted(GOLDEN))
def case(request, spark):
    df = enriched(spark, sf_dir(request.param)).cache()
    yield GOLDEN[request.param], df
    df.unpersist()


def test_adapter_counts(case):
    g, df = case
    r = df.agg(F.count(F.lit(1)), F.count_distinct("product_id"), F.count_distinct("store_id"),
               F.count_distinct("vendor"), F.sum("stockout_risk"),
               F.count_if(F.col("units_sold") == 0)).first()
    assert tuple(r) == (g["rows"], g["products"], g["stores"], g["vendors"], g["risk"],
                        g["zero_sales"])


def test_stock_health(case):
    g, df = case
    r = H.stock_health(df).first()
    assert (r.critical_rows, r.warning_rows, r.healthy_rows) == g["health"]
    assert r.total_value == g["value"]
    assert r.lead_time_alert_rows == g["lt_risk"]


def test_latest_snapshot(case):
    g, df = case
    r = P.snapshot_kpis(df).first()
    assert str(r.latest_date) == "2001-11-04"
    assert (r.snapshot_rows, r.total_stock) == g["latest"][:2]
    sold = P.latest_snapshot(df).agg(F.sum("units_sold")).first()[0]
    assert sold == g["latest"][2]


def test_urgency_counts_and_half_days(case):
    g, df = case
    got = {r.urgency: r.item_count for r in L.urgency_counts(df).collect()}
    assert tuple(got[s] for s in L.URGENCY_STATUSES) == g["urgency"]
    half = L.selling_items(df).where(F.col("inventory_level") / F.col("units_sold") == 14.5).count()
    assert half == g["half"]


def test_vendor_top_and_tiers(case):
    g, df = case
    s = V.vendor_summary(df).first()
    assert (s.best_vendor, s.best_score) == g["top"]
    tiers = {r.tier: r["count"] for r in V.vendor_cards(df).groupBy("tier").count().collect()}
    assert (tiers.get("Excellent", 0), tiers.get("Good", 0), tiers.get("Needs Improvement", 0)) \
        == g["tiers"]
