"""Inventory observations derived from the TPC-H style star schema.

The test data has no inventory file, so this adapter derives one observation
per lineitem (ship date, region of the ordering customer as store, part as
product, supplier as vendor).  The same text exists as SQL for the oracle
(``shelfwise.plans.oracle.ADAPTER_SQL``).

Plan shape: lineitem is the only fact table.  Dimension sides are pruned to
the two or three columns used, and the join strategy is left to Catalyst and
AQE: sides under ``spark.sql.autoBroadcastJoinThreshold`` (nation, region and,
at small scale, part/supplier/orders) are broadcast after Spark's own size
check; at cluster scale the large sides become sort-merge joins whose skewed
partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import schema as S

# Part type -> product category of the adapter.
PART_TYPE_CATEGORY = {
    "ECONOMY": "Groceries",
    "LARGE": "Furniture",
    "MEDIUM": "Clothing",
    "PROMO": "Toys",
    "SMALL": "Electronics",
}
OTHER_CATEGORY = "Other"
SEQ_TYPE = "decimal(38,0)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def star_schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation, as the keys and looked-up values that ``inventory_of`` derives the table from.

    Most columns of the inventory follow from the keys, so a shuffle of these rows moves far fewer bytes.
    """
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    # Store of an order = region of its customer.  Resolved on the orders
    # side first, so lineitem joins one (orderkey -> store) relation.
    order_store = (orders
                   .join(customer, orders.o_custkey == customer.c_custkey)
                   .join(nation, F.col("c_nationkey") == nation.n_nationkey)
                   .join(region, F.col("n_regionkey") == region.r_regionkey)
                   .select("o_orderkey", "r_name"))

    # Fact first with its part/supplier lookups, then the order side.  Without
    # table statistics Spark sizes a join as the product of its inputs, so
    # joining the pre-joined order side last keeps the fact from ever looking
    # like the smaller (broadcast) side; AQE still picks a broadcast from the
    # actual shuffle sizes at runtime when the order side is small.
    joined = (li
              .join(part, li.l_partkey == part.p_partkey)
              .join(supplier, li.l_suppkey == supplier.s_suppkey)
              .join(order_store, li.l_orderkey == order_store.o_orderkey))

    return joined.select(F.to_date(F.col("l_shipdate")).alias(S.OBS_DATE), "l_orderkey", "l_partkey", "l_suppkey",
                         "l_linenumber", "l_quantity", "r_name", "p_type", "p_retailprice", "s_name")


def inventory_of(rows: DataFrame) -> DataFrame:
    """The inventory table of ``star_schema_rows``, row by row."""
    category = None
    for ptype, cat in PART_TYPE_CATEGORY.items():
        cond = F.col("p_type") == F.lit(ptype)
        category = F.when(cond, F.lit(cat)) if category is None else category.when(cond, F.lit(cat))
    category = category.otherwise(F.lit(OTHER_CATEGORY))

    ok, pk, sk, ln = (F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"),
                      F.col("l_linenumber"))
    return rows.select(
        S.OBS_DATE,
        F.col("r_name").alias(S.STORE),
        pk.alias(S.PRODUCT),
        category.alias(S.CATEGORY),
        ((pk * 7 + ok * 13 + ln * 31) % 501).cast("double").alias(S.INV),
        (F.col("l_quantity") - F.lit(1.0)).alias(S.SOLD),
        ((ok * 17 + pk * 3) % 180 + 20).cast("double").alias(S.ORDERED),
        ((F.col("l_quantity").cast("bigint") - 1) * 5 + pk % 11).cast("double").alias(S.FORECAST),
        F.col("p_retailprice").alias(S.PRICE),
        F.col("s_name").alias(S.VENDOR),
        (F.lit(1) + sk % 14).cast("double").alias(S.DELIVERY),
        row_seq().alias(S.ROW_SEQ),
    )


def row_seq() -> Column:
    """FIXTURES.md's packed row sequence of ``star_schema_rows``.

    Evaluated in DECIMAL(38,0): the same values at test scale, and no BIGINT overflow
    (ANSI error) once order keys pass ~10^9, i.e. beyond scale factor ~1000.
    """
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return (((ok.cast(SEQ_TYPE) * 8 + ln) * 100000 + pk) * 10000 + sk).cast(SEQ_TYPE)


def file_order() -> list[Column]:
    """Two BIGINT keys of ``star_schema_rows`` in the order of ``row_seq``: many times cheaper to compare.

    They are its digits above and below 10^9; keys of orders up to 10^18 and of parts up to 9 * 10^14 fit.
    """
    ok, pk, sk, ln = (F.col(c).cast("bigint") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    low = pk * 10000 + sk
    digits = F.lit(10 ** 9).cast("bigint")
    rest = F.pmod(low, digits)
    return [ok * 8 + ln + F.call_function("div", low - rest, digits), rest]


def star_schema_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory table (schema of ``shelfwise.schema``) over ``sf_dir``."""
    return inventory_of(star_schema_rows(spark, sf_dir))


def observed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of the observations, a row for each line item, from that table alone."""
    return _table(spark, sf_dir, "lineitem").select(F.to_date(F.col("l_shipdate")).alias(S.OBS_DATE))
