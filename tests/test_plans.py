"""Plan checks: no Python evaluation, pushed filters, partial aggregation, bounded broadcasts."""

import os
import tempfile

import pytest

from conftest import sf_dir
from shelfwise.operators import overview as H
from shelfwise.operators import products as P
from shelfwise.operators import suppliers as V
from shelfwise.plans.catalog import MODEL_REPORTS, QUERIES, REPORTS, enriched
from shelfwise.sources.inventory import load_enriched, save_enriched


@pytest.fixture(scope="module")
def table(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="shelfwise-plan-"), "enriched")
    save_enriched(enriched(spark, sf_dir("0.001")), out, files=4)
    return load_enriched(spark, out)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in REPORTS if n not in MODEL_REPORTS])
def test_no_python_in_plan(table, name):
    p = plan(REPORTS[name](table))
    assert "EvalPython" not in p and "PythonUDF" not in p and "FlatMapGroupsInPandas" not in p


def test_latest_snapshot_filter_reaches_scan(table):
    text = P.latest_snapshot(table)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(obs_date), EqualTo(obs_date,ScalarSubquery" in text


def nodes(jplan):
    """Every node of an executed plan, subqueries left out, with its parent's name."""
    out, todo = [], [(jplan, "")]
    while todo:
        node, above = todo.pop()
        name = node.nodeName()
        out.append((node, name, above))
        if name == "AdaptiveSparkPlan":
            kids = [node.executedPlan()]
        elif name in ("InMemoryTableScan",):
            kids = [node.relation().cachedPlan()]
        else:
            children = node.children()
            kids = [children.apply(i) for i in range(children.size())]
        todo += [(k, name) for k in kids]
    return out


def below(node):
    return [name for _, name, _ in nodes(node)]


FACT_AGGREGATES = ["p9_product_labels", "p10_product_detail", "p12_cover_verdict", "l10_product_order_status",
                   "l11_coverage_plan", "f4_current_product_rows", "f7_order_recommendation", "f10_supply_scenarios"]


@pytest.mark.parametrize("name", FACT_AGGREGATES)
def test_fact_rows_are_hashed_not_sorted(table, name):
    """A sort-based aggregation stands only above a hash aggregation of the fact rows."""
    found = [n for n, kind, _ in nodes(REPORTS[name](table)._jdf.queryExecution().executedPlan()) if kind == "SortAggregate"]
    assert all("HashAggregate" in below(n) for n in found)


@pytest.mark.parametrize("name,columns", [
    ("p9_product_labels", "obs_date product_id category row_seq"),
    ("l10_product_order_status", "obs_date product_id inventory_level units_sold price row_seq"),
    ("f10_supply_scenarios", "obs_date product_id inventory_level units_sold row_seq"),
    ("f7_order_recommendation", "obs_date product_id inventory_level units_sold demand_forecast "
                                "vendor_avg_delivery_days row_seq days_to_stockout")])
def test_scans_read_only_what_is_used(table, name, columns):
    scans = [n for n, kind, _ in nodes(REPORTS[name](table)._jdf.queryExecution().executedPlan())
             if kind.startswith("Scan parquet")]
    assert scans
    for scan in scans:
        assert set(scan.requiredSchema().fieldNames()) <= set(columns.split())


def test_aggregations_are_partial_before_shuffle(table):
    """Below each shuffle that an aggregation needs stands its partial half."""
    for df in (H.category_stock(table), V.vendor_metrics(table), P.product_labels(table), H.stock_health(table)):
        shuffles = [n for n, kind, above in nodes(df._jdf.queryExecution().executedPlan())
                    if kind == "Exchange" and "Aggregate" in above]
        assert shuffles
        for n in shuffles:
            child = n.children().apply(0)
            assert "Aggregate" in child.nodeName() and ("partial_" in child.toString().split("\n")[0]
                                                        or "functions=[]" in child.toString().split("\n")[0])


@pytest.mark.parametrize("name", ["h7_category_weather_impact", "v5_vendor_scores", "w3_seasonal_exposure",
                                  "h13_category_share", "w2_seasonal_items"])
def test_broadcasts_are_bounded(table, name):
    """Nothing below a broadcast scans the table unless it is aggregated first."""
    for n, kind, _ in nodes(REPORTS[name](table)._jdf.queryExecution().executedPlan()):
        if kind == "BroadcastExchange":
            kinds = below(n)
            assert not any("Scan parquet" in k for k in kinds) or any("Aggregate" in k for k in kinds), kinds


def test_snapshot_queries_read_line_items_once(spark):
    """The registered queries run over one stored table, and the date filter reaches its scan."""
    for name in ("p1_latest_snapshot", "p4_snapshot_kpis", "p6_top_sellers", "p12_cover_verdict"):
        text = plan(QUERIES[name](spark, sf_dir("0.001")))
        assert "lineitem" not in text and "EqualTo(obs_date,ScalarSubquery" in text


def test_unused_weather_is_not_looked_up(table):
    assert "Join" not in plan(H.stock_health(table))


def test_latest_snapshot_prunes_date_partitions(spark):
    """On a table partitioned by date, the latest-date subquery prunes partitions."""
    out = os.path.join(tempfile.mkdtemp(prefix="shelfwise-part-"), "enriched")
    # A small fixture (the last weeks, one writer) keeps the directory count low.
    recent = enriched(spark, sf_dir("0.001")).where("obs_date >= DATE'2001-10-01'").coalesce(1)
    save_enriched(recent, out, partition_by=("obs_date",))
    snap = P.latest_snapshot(load_enriched(spark, out))
    text = plan(snap)
    assert "PartitionFilters: [isnotnull(obs_date" in text and "= Subquery" in text
    assert snap.count() == 2


@pytest.mark.parametrize("name", [n for n in REPORTS if n not in MODEL_REPORTS])
def test_no_cross_join(table, name):
    p = plan(REPORTS[name](table))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_ranks_are_numbered_where_the_rows_lie(table, spark):
    """A window only ever sees the counts of partitions."""
    from pyspark.sql import functions as F

    from shelfwise.operators.common import ranked
    for name in ("h13_category_share", "h14_value_share"):
        windows = [n for n, kind, _ in nodes(REPORTS[name](table)._jdf.queryExecution().executedPlan()) if kind == "Window"]
        assert windows
        for w in windows:
            first = next(n for n, kind, _ in nodes(w) if "Aggregate" in kind)
            assert "output=[_part" in first.toString().split("\n")[0]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # partitions aren't put together
    try:
        rows = spark.range(5000).select(((F.col("id") * 37) % 101).alias("v"), F.col("id").alias("k"))
        out = ranked(rows, [F.col("v").desc(), F.col("k")], "r").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    want = sorted(out, key=lambda r: (-r["v"], r["k"]))
    assert [r["r"] for r in want] == list(range(1, 5001))
