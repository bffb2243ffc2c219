"""The query catalog: one named report plan per operator group.

``REPORTS`` maps a name to an operator over the enriched inventory table;
``QUERIES`` wraps each one as ``(spark, sf_dir) -> DataFrame`` over the
inventory table that is derived from the star-schema tables under ``sf_dir``,
enriched and stored once per session and state of its sources.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as sf

from shelfwise import schema as S
from shelfwise.operators import metrics as M
from shelfwise.operators import overview as H
from shelfwise.operators import procurement as L
from shelfwise.operators import products as P
from shelfwise.operators import risk as F
from shelfwise.operators import seasonal as W
from shelfwise.operators import suppliers as V
from shelfwise.session import scratch_path, shuffle_partitions
from shelfwise.sources.guard import guarded_inventory, problem_counts
from shelfwise.sources.inventory import ROWS_PER_FILE, load_enriched, normalise_missing, read_inventory, save_enriched
from shelfwise.sources.star import file_order, inventory_of, observed_dates, star_schema_inventory, star_schema_rows
from shelfwise.sources.stored import stored_table

Query = Callable[[SparkSession, str], DataFrame]


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched inventory table, derived from the star-schema tables."""
    return M.enrich(star_schema_inventory(spark, sf_dir))


#: the star-schema tables that the inventory table is derived from
SOURCES = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")


def _kept(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The path of a table derived from the star-schema tables, for this session and as they are now."""
    app = spark.sparkContext.applicationId
    tables = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in SOURCES]

    def build(path: str) -> None:
        with shuffle_partitions(spark, _parts(spark, sf_dir)):
            write(path)

    return stored_table(spark, scratch_path(spark, f"{name}-{app}"), tables, build)


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of ``ROWS_PER_FILE`` rows that the observations make."""
    return -(-observed_dates(spark, sf_dir).count() // ROWS_PER_FILE)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched table, written once per session and state of its sources to the shared checkpoint folder.

    Clustered by date, so that the latest snapshot is found by the files' statistics.  The
    joined keys are dealt and sorted; the table's columns are derived from them as they are written.
    """
    def write(path: str) -> None:
        save_enriched(star_schema_rows(spark, sf_dir), path, dates=observed_dates(spark, sf_dir),
                      order=file_order(), derive=lambda rows: M.enrich(inventory_of(rows)))

    return load_enriched(spark, _kept(spark, sf_dir, "enriched", write))


Report = Callable[[DataFrame], DataFrame]


SEASONAL_ROW_COLUMNS = (S.OBS_DATE, S.STORE, S.PRODUCT, S.CATEGORY, S.INV, S.SOLD, S.PRICE,
                        M.VALUE)

# The pick that the scoped reports are registered with.
SCOPE = ("Toys", "EUROPE")

REPORTS: dict[str, Report] = {
    # enrichment (the enriched table itself; the row sequence shown as text)
    "m_enrich": lambda df: df.withColumn(S.ROW_SEQ, df[S.ROW_SEQ].cast("string")),
    # overview
    "h1_stock_health": H.stock_health,
    "h3_critical_items": H.critical_items,
    "h5_lead_time_alerts": H.lead_time_alerts,
    "h7_category_weather_impact": H.category_weather_impact,
    "h8_top_weather_impacts": H.top_weather_impacts,
    "h9_weather_summary": H.weather_impact_summary,
    "h10_category_stock": H.category_stock,
    "h11_category_leaders": H.category_leaders,
    "h13_category_share": H.category_share,
    "h14_value_share": lambda df: H.category_share(df, by="value"),
    # products
    "p1_latest_snapshot": lambda df: P.latest_snapshot(df).select(*P.SNAPSHOT_COLUMNS),
    "p2_scoped_history": lambda df: P.product_history_counts(df, *SCOPE),
    "p2_scoped_kpis": lambda df: P.snapshot_kpis(df, category=SCOPE[0]),
    "p2_scoped_top_sellers": lambda df: P.top_sellers(df, 10, store=SCOPE[1]),
    "p3_filter_options": P.filter_options,
    "p4_snapshot_kpis": P.snapshot_kpis,
    "p5_snapshot_category_stock": P.snapshot_category_stock,
    "p6_top_sellers": lambda df: P.top_sellers(df, n=10),
    "p8_highest_stock": lambda df: P.highest_stock(df, n=5),
    "p9_product_labels": P.product_labels,
    "p10_product_detail": P.product_detail,
    "p11_product_history": P.product_history_counts,
    "p12_cover_verdict": P.cover_verdict,
    # suppliers
    "v1_vendor_metrics": V.vendor_metrics,
    "v5_vendor_scores": V.vendor_scores,
    "v7_vendor_summary": V.vendor_summary,
    "v10_vendor_cards": V.vendor_cards,
    # procurement
    "l4_urgency_counts": L.urgency_counts,
    "l5_order_today": L.order_today,
    "l6_order_this_week": L.order_this_week,
    "l7_vendor_speed": L.vendor_speed,
    "l8_vendor_speed_extremes": L.vendor_speed_extremes,
    "l9_order_budget": L.order_budget,
    "l10_product_order_status": L.product_order_status,
    "l11_coverage_plan": L.coverage_plan,
    # seasonal
    "w2_seasonal_items": lambda df: W.seasonal_items(df).select(*SEASONAL_ROW_COLUMNS),
    "w3_seasonal_exposure": W.seasonal_exposure,
    "w5_category_outlook": W.category_outlook,
    # risk model and order advice
    "f1_training_rows": F.training_report,
    "f2_feature_scaling": F.feature_scaling,
    "f3_forest_nodes": F.forest_nodes,
    "f4_current_product_rows": F.current_product_rows,
    "f5_risk_inputs": F.risk_inputs,
    "f5_risk_scores": F.risk_scores,
    "f5_forest_scores": F.forest_scores,
    "f7_order_recommendation": F.order_recommendation,
    "f10_supply_scenarios": F.supply_scenarios,
}


def _query(op: Report) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(stored(spark, sf_dir))
    run.__doc__ = op.__doc__
    return run


QUERIES: dict[str, Query] = {name: _query(op) for name, op in REPORTS.items()}

def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 over the given line items: quantities of 13 marked NaN, flags of R marked missing, then normalised."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    marked = li.withColumns({
        "l_quantity": sf.when(sf.col("l_quantity") == 13, sf.lit(float("nan"))).otherwise(sf.col("l_quantity").cast("double")),
        "l_returnflag": sf.when(sf.col("l_returnflag") == "R", sf.lit("NA")).when(
            sf.col("l_returnflag") == "A", sf.lit(" NA ")).otherwise(sf.col("l_returnflag"))})
    done = normalise_missing(marked, text=True)
    return done.groupBy("l_returnflag").agg(
        sf.count("*").alias("row_count"), sf.count("l_quantity").alias("with_quantity"),
        sf.sum("l_quantity").alias("quantity"))


def _csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory table as texts under the engine's names, with month/day/year dates, and its row_seq."""
    return _texts(star_schema_inventory(spark, sf_dir))


def _texts(inv: DataFrame) -> DataFrame:
    text = {c: sf.col(c).cast("string") for c in S.CSV_HEADERS.values()}
    text[S.OBS_DATE] = sf.date_format(S.OBS_DATE, "MM/dd/yyyy")
    return inv.select(*[text[c].alias(c) for c in text], S.ROW_SEQ)


def _write_csv(texts: DataFrame, path: str) -> None:
    texts.select(*[sf.col(c).alias(h) for h, c in S.CSV_HEADERS.items()]) \
        .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory table written as the dashboard's CSV, with month/day/year
    dates, read back, validated and enriched; its stock health and the span of its rows."""
    path = _kept(spark, sf_dir, "csv", lambda at: _write_csv(_csv_texts(spark, sf_dir), at))
    df = M.enrich(read_inventory(spark, path))
    span = df.agg(sf.min(S.OBS_DATE).alias("first_date"), sf.max(S.OBS_DATE).alias("last_date"),
                  sf.count_distinct(S.ROW_SEQ).alias("row_numbers"))
    health = H.stock_health(df)
    return health.join(span, sf.col("total_rows") == sf.col("row_numbers"), "left")


#: vendors' names in the awkward file: quotes and commas, line breaks, or as they are, by product
AWKWARD = {0: ' "The, Best" Co', 1: ",\nof two lines"}


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a CSV in file order, with quotes, commas and line breaks in its vendors,
    day/month/year dates with a time, and the stock of the product's row before it in the file."""
    # a file with line breaks is sorted, written and read by one task: more rows make more files, not larger ones
    files = max(8, _parts(spark, sf_dir))

    def write(path: str) -> None:
        keys = dict(zip(("_high", "_low"), file_order()))
        order = [*keys, S.OBS_DATE, "l_quantity"]
        rows = star_schema_rows(spark, sf_dir).withColumns(keys).repartitionByRange(files, *order).sortWithinPartitions(*order)
        texts = _texts(inventory_of(rows))
        kind = sf.pmod(sf.col(S.PRODUCT).cast("bigint"), sf.lit(3))
        odd = sf.create_map(*[sf.lit(x) for k in AWKWARD for x in (k, AWKWARD[k])])
        vendor = sf.concat(S.VENDOR, sf.coalesce(odd[kind.cast("int")], sf.lit("")))
        date = sf.date_format(sf.to_date(S.OBS_DATE, "MM/dd/yyyy"), "dd/MM/yyyy 08:30")
        _write_csv(texts.withColumns({S.VENDOR: vendor, S.OBS_DATE: date}), path)

    path = _kept(spark, sf_dir, "csv-awkward", write)
    df = read_inventory(spark, path, multiline=True).repartition(files, S.PRODUCT)
    before = Window.partitionBy(S.PRODUCT).orderBy(S.ROW_SEQ)
    return df.select(*S.CSV_HEADERS.values(), sf.lag(S.INV).over(before).alias("stock_before"))


#: what is put into the damaged file, by remainders of its row numbers: column, text, divisor
DAMAGE = ((S.OBS_DATE, "soon", 101), (S.INV, "lots", 103), (S.PRICE, "12,50", 107), (S.DELIVERY, "NA", 109))


def load_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the inventory table as a CSV with dates and numbers that are none, loaded by the guard: the rows of
    each combination of problems and, of the sound ones (``none``), what was loaded."""
    def write(path: str) -> None:
        texts = _csv_texts(spark, sf_dir)
        hit = lambda n: sf.col(S.ROW_SEQ) % sf.lit(n).cast(texts.schema[S.ROW_SEQ].dataType) == 0
        _write_csv(texts.withColumns({c: sf.when(hit(n), sf.lit(t)).otherwise(sf.col(c)) for c, t, n in DAMAGE}), path)

    path = _kept(spark, sf_dir, "csv-damaged", write)
    out = scratch_path(spark, f"guarded-{uuid.uuid4().hex}")
    found = guarded_inventory(spark, path, out)
    loaded = found.accepted.agg(sf.sum(S.INV).alias("stock"), sf.count(S.DELIVERY).alias("with_delivery"),
                                sf.max(S.OBS_DATE).alias("last_date")).select("*", sf.lit("none").alias("problem"))
    return problem_counts(found).join(loaded, "problem", "left")


QUERIES["s1_csv_ingest"] = csv_ingest
QUERIES["s1_csv_rows"] = csv_rows
QUERIES["s3_load_guard"] = load_guard
QUERIES["s5_missing_values"] = missing_values

# Reports whose result has no SQL oracle (a fitted model).
MODEL_REPORTS = ("f3_forest_nodes", "f5_risk_scores", "f5_forest_scores")
