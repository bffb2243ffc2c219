"""One vendor holding over a third of all rows: results stay exact, aggregation stays partial."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from shelfwise.operators import overview as H
from shelfwise.operators import procurement as L
from shelfwise.operators import suppliers as V
from shelfwise.plans.catalog import enriched

HOT = "Supplier#000000000"


@pytest.fixture(scope="module")
def skewed(spark):
    base = enriched(spark, sf_dir("0.001"))
    hot = base.where(F.col("vendor") == HOT)
    # Replicate the hot vendor's rows (with fresh row sequences) until it
    # holds well over a third of the table.
    copies = [hot.withColumn("row_seq", (F.col("row_seq") + F.expr(f"CAST({i}E20 AS DECIMAL(38,0))"))
                             .cast("decimal(38,0)")) for i in range(1, 6)]
    df = base
    for c in copies:
        df = df.unionByName(c)
    out = os.path.join(tempfile.mkdtemp(prefix="shelfwise-skew-"), "t")
    df.repartition(8).write.parquet(out)
    return spark.read.parquet(out)


def test_hot_vendor_share(skewed):
    total = skewed.count()
    hot = skewed.where(F.col("vendor") == HOT).count()
    assert hot > total / 3


def test_vendor_metrics_exact_under_skew(skewed):
    pdf = skewed.select("vendor", "vendor_avg_delivery_days", "units_ordered", "stockout_risk",
                        "product_id").toPandas()
    want = pdf.groupby("vendor").agg(
        avg_delivery_days=("vendor_avg_delivery_days", "mean"),
        units_ordered=("units_ordered", "sum"),
        stockout_rate=("stockout_risk", "mean"),
        product_count=("product_id", "nunique"))
    got = V.vendor_metrics(skewed).toPandas().set_index("vendor").sort_index()
    pd.testing.assert_frame_equal(got[want.columns], want.sort_index(), check_dtype=False)


def test_category_totals_and_first_rows_under_skew(skewed):
    pdf = skewed.select("category", "inventory_level", "product_id").toPandas()
    want = pdf.groupby("category")["inventory_level"].sum().to_dict()
    got = {r.category: r.total_units for r in H.category_stock(skewed).collect()}
    assert got == want
    items = L.order_items(skewed).select("product_id", "obs_date", "row_seq", "units_sold",
                                         "urgency").toPandas()
    first = (items.sort_values(["obs_date", "row_seq", "units_sold"])
                  .groupby("product_id").head(1).set_index("product_id")["urgency"].to_dict())
    got_first = {r.product_id: r.urgency for r in L.product_order_status(skewed).collect()}
    assert got_first == first


def test_every_shuffle_follows_a_partial_aggregate(skewed):
    """No fact rows cross a shuffle un-aggregated in the grouped reports."""
    for df in (V.vendor_metrics(skewed), H.category_stock(skewed), L.product_order_status(skewed)):
        text = df._jdf.queryExecution().executedPlan().toString()
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                below = "\n".join(lines[i + 1:i + 3])
                assert "partial_" in below or "Aggregate" in below, (line, below)
