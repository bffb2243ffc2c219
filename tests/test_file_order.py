"""One file-order rule: missing dates last, first and last rows, nothing lost to missing values."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import overview as H
from shelfwise.operators import procurement as L
from shelfwise.operators import products as P
from shelfwise.operators import risk as R
from shelfwise.operators import suppliers as V
from shelfwise.operators.metrics import enrich
from shelfwise.schema import INVENTORY_SCHEMA


def rows():
    rng, out = random.Random(4), []
    for k in range(300):
        date = None if k % 11 == 0 else dt.date(2025, 1, 1 + rng.randrange(5))
        num = lambda p=0.1: None if rng.random() < p else float(rng.randrange(0, 60))
        out.append((date, f"S{rng.randrange(3)}", f"P{rng.randrange(12)}", rng.choice(["Toys", "Clothing", None, "X"]),
                    num(), num(), num(), num(), num(), "V", num(), k))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark):
    return enrich(spark.createDataFrame(rows(), INVENTORY_SCHEMA)).cache()


@pytest.fixture(scope="module")
def con(df):
    db = duckdb.connect()
    db.register("enr", df.toPandas())
    return db


def sql(con, column, which, where="true"):
    order = "obs_date NULLS LAST, row_seq" if which == "first" else "obs_date DESC NULLS FIRST, row_seq DESC"
    found = con.execute(f"""SELECT product_id, {column} FROM (SELECT *, row_number() OVER (PARTITION BY product_id
        ORDER BY {order}) AS k FROM enr WHERE {where}) WHERE k = 1""").fetchall()
    return {p: None if v != v else v for p, v in found}


def test_first_and_last_rows_agree_with_sql(df, con):
    got = lambda d, c: {r["product_id"]: r[c] for r in d.collect()}
    assert got(P.product_labels(df), "category") == sql(con, "category", "first")
    for which in ("first", "last"):
        assert got(L.product_order_status(df, which), "inventory_level") == sql(con, "inventory_level", which, "units_sold > 0")
        cur = R.current_product_rows(df, which)
        for c in ("store_id", "category", "price", "demand_forecast"):
            assert got(cur, c) == sql(con, c, which), (which, c)
    alerts = con.execute("SELECT product_id FROM enr WHERE lead_time_risk = 1 ORDER BY obs_date NULLS LAST, row_seq").fetchall()
    n = len(alerts)
    assert [r["product_id"] for r in H.lead_time_alerts(df, n=n).orderBy("rank").collect()] == [a[0] for a in alerts]
    latest = "obs_date = (SELECT max(obs_date) FROM enr)"
    assert got(P.product_detail(df, with_category=True), "category") == sql(con, "category", "first", latest)


def test_other_order_columns(df):
    flipped = df.withColumn("line", F.lit(1000) - F.col("row_seq"))
    first = {r["product_id"]: r["price"] for r in R.current_product_rows(flipped, "first", order_cols=("line",)).collect()}
    last = {r["product_id"]: r["price"] for r in R.current_product_rows(df, "last", order_cols=("row_seq",)).collect()}
    assert first == last
    with pytest.raises(ValueError):
        R.current_product_rows(df, "middle")


def test_missing_values_come_last_and_stay(df):
    snap = P.latest_snapshot(df).count()
    for top, c in ((P.top_sellers(df, n=1000), "units_sold"), (P.highest_stock(df, n=1000), "inventory_level")):
        got = [r[c] for r in top.orderBy("rank").collect()]
        assert len(got) == snap
        known = [x for x in got if x is not None]
        assert None in got and got == sorted(known, reverse=True) + [None] * (snap - len(known))


def test_every_product_is_scored(spark):
    base = [(dt.date(2025, 1, d), "S", f"P{p}", "Toys", float(d * p % 50), float(p), 1.0, 20.0, 3.0, "V",
             None if p == 3 and d == 9 else 2.0, d * 100 + p) for p in range(8) for d in range(1, 10)]
    df = enrich(spark.createDataFrame(base, INVENTORY_SCHEMA))
    out = {r["product_id"]: r for r in R.risk_scores(df, trees=3).collect()}
    assert len(out) == R.current_product_rows(df).count() == 8
    assert out["P3"].risk_score is None and out["P3"].risk_level is None and out["P3"].units_sold == 3.0
    assert all(r.risk_score is not None and r.risk_level for p, r in out.items() if p != "P3")


def test_scores_do_not_depend_on_the_layout(spark):
    rng = random.Random(1)
    base = [(dt.date(2025, 1, 1 + k % 28), f"S{k % 3}", f"P{k % 200}", "Toys", float(rng.randrange(100)),
             float(rng.randrange(1, 20)), 1.0, float(rng.randrange(90)), 3.0, "V", float(rng.randrange(9)), k)
            for k in range(3000)]
    df = spark.createDataFrame(base, INVENTORY_SCHEMA)
    got = [sorted(tuple(r) for r in R.risk_scores(enrich(df.repartition(n)), trees=5, max_train_rows=limit).collect())
           for limit in (10 ** 6, 1500) for n in (8, 16)]
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2]


def test_weights_are_checked(df):
    with pytest.raises(ValueError):
        V.vendor_scores(df, weights=(4000, 3000, 3000))
    with pytest.raises(ValueError):
        V.vendor_scores(df, weights=(-0.1, 0.5, 0.5))


def test_money_is_not_rounded_row_by_row(spark):
    base = [(dt.date(2025, 1, 1), "S", "P", "Toys", 1.0, 1.0, 1.0, 1.0, 0.333, "V", 1.0, k) for k in range(1000)]
    df = enrich(spark.createDataFrame(base, INVENTORY_SCHEMA))
    assert H.stock_health(df).first().total_value == 333.0


def test_a_repeated_weather_key_is_refused(spark):
    base = spark.createDataFrame(rows()[:5], INVENTORY_SCHEMA)
    twice = spark.createDataFrame([("Toys", "Winter", 1.0)] * 2, "category string, season string, weather_multiplier double")
    with pytest.raises(ValueError):
        enrich(base, twice)
