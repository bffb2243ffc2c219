"""Row metrics M1-M16 on the edge rows, plus the missing-value cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edge_rows import EDGE, edge_frame, f
from shelfwise.operators import metrics as M
from shelfwise.operators import procurement as L
from shelfwise.schema import INVENTORY_SCHEMA


@pytest.fixture(scope="module")
def enriched_edge(spark):
    rows = M.enrich(edge_frame(spark)).collect()
    return {int(r.product_id): r for r in rows}


@pytest.mark.parametrize("row", EDGE, ids=[str(r[0]) for r in EDGE])
def test_edge_row_metrics(enriched_edge, row):
    k, inv, sold, fc, lead, days, status, risk, rop, lt, target, sugg, _dl, _urg = row
    r = enriched_edge[k]
    assert r.days_to_stockout == f(days)
    assert r.stock_status == status
    assert r.stockout_risk == risk
    assert r.reorder_point == f(rop)
    assert r.lead_time_risk == lt
    assert r.target_stock_level == f(target)
    assert r.suggested_order_qty == f(sugg)
    assert r.safety_stock_days == (None if lead is None else lead * 1.5)
    assert r.total_value == (None if inv is None else inv * 10.0)


def test_edge_row_urgency(spark):
    got = {int(r.product_id): (r.days_left, r.urgency)
           for r in L.order_items(edge_frame(spark)).collect()}
    for k, *_x, days_left, urgency in EDGE:
        if urgency == "dropped":
            assert k not in got
        else:
            assert got[k] == (f(days_left), urgency)


def test_half_even_rounding_of_days_left(spark):
    # 14.5 days rounds to 14 ("Order Soon"), not 15 ("Good for Now").
    r = L.order_items(edge_frame(spark)).where("product_id = '5'").first()
    assert (r.days_left, r.urgency) == (14.0, "Order Soon")


def test_weather_multiplier_defaults(spark):
    rows = [
        (dt.date(2025, 7, 1), "S", "1", "Toys", 1.0, 1.0, 1.0, 10.0, 1.0, "V", 1.0, 1),
        (dt.date(2025, 7, 1), "S", "2", "Gadgets", 1.0, 1.0, 1.0, 10.0, 1.0, "V", 1.0, 2),
        (dt.date(2025, 1, 1), "S", "3", None, 1.0, 1.0, 1.0, 10.0, 1.0, "V", 1.0, 3),
        (None, "S", "4", "Toys", 1.0, 1.0, 1.0, 10.0, 1.0, "V", 1.0, 4),
        (None, "S", "5", "Gadgets", 1.0, 1.0, 1.0, 10.0, 1.0, "V", 1.0, 5),
    ]
    got = {r.product_id: (r.season, r.weather_multiplier, r.weather_adjusted_demand)
           for r in M.enrich(spark.createDataFrame(rows, INVENTORY_SCHEMA)).collect()}
    assert got["1"] == ("Summer", 1.5, 15.0)      # table value
    assert got["2"] == ("Summer", 1.2, 12.0)      # unknown category: default season value
    assert got["3"] == ("Winter", 1.1, 11.0)  # missing category: default
    assert got["4"][:2] == (None, 1.0)            # missing date: 1.0
    assert got["5"][:2] == (None, 1.0)


def test_impact_score_is_double_arithmetic(spark):
    r = M.enrich(edge_frame(spark, date=dt.date(2025, 9, 1), category="Toys")).first()
    assert r.weather_multiplier == 1.1
    assert r.weather_impact_score == (1.1 - 1) * 100


def test_enrich_is_narrow(spark):
    """Enrichment adds no shuffle: its plan has no exchange and no join."""
    plan = M.enrich(edge_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "ShuffleExchange" not in plan and "Exchange hashpartitioning" not in plan
    assert "PythonUDF" not in plan and "EvalPython" not in plan


def test_nan_is_treated_as_missing(spark):
    from shelfwise.sources.inventory import normalise_missing
    rows = [(dt.date(2025, 1, 1), "S", "1", "Toys", float("nan"), 10.0, 5.0, 3.0, 1.0, "V", 2.0, 1)]
    df = M.enrich(normalise_missing(spark.createDataFrame(rows, INVENTORY_SCHEMA)))
    r = df.first()
    assert r.inventory_level is None
    assert r.stockout_risk == 0 and r.lead_time_risk == 0
    assert r.days_to_stockout is None and r.stock_status is None
    assert df.select(F.count_if(F.col("days_to_stockout") > 0)).first()[0] == 0
