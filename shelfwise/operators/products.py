"""Product analysis reports P1-P13.

The dashboard answers for one picked product or filter; these operators
answer for every product at once, and a pick is a ``where`` on the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import schema as S
from shelfwise.functions.exprs import (money_sum, order_keys, order_number, order_number_date,
                                       order_number_seq, round_half_even, trunc_to_long,
                                       with_order_cols)
from shelfwise.operators import metrics as M
from shelfwise.operators.common import end_rows, top_n

SNAPSHOT_COLUMNS = (S.OBS_DATE, S.STORE, S.PRODUCT, S.CATEGORY, S.INV, S.SOLD, S.PRICE,
                    M.VALUE, S.VENDOR, M.DAYS, M.STATUS)


def scope(df: DataFrame, category: str | None = None, store: str | None = None) -> DataFrame:
    """Optional category and store equality; ``None`` means all."""
    if category is not None:
        df = df.where(F.col(S.CATEGORY) == F.lit(category))
    if store is not None:
        df = df.where(F.col(S.STORE) == F.lit(store))
    return df


def latest_snapshot(df: DataFrame, category: str | None = None,
                    store: str | None = None) -> DataFrame:
    """P1 (+P2): rows observed on the latest date of the whole table.

    The latest date is a scalar subquery, so the outer filter is
    ``obs_date = <subquery>``: it is pushed to the Parquet scan and, on a
    table partitioned by ``obs_date``, prunes partitions at runtime.
    """
    latest = df.select(F.max(S.OBS_DATE)).scalar()
    return scope(df.where(F.col(S.OBS_DATE) == latest), category, store)


def _first_seen_columns() -> list:
    return [order_number_date("_f").alias("first_seen_date"),
            order_number_seq("_f").cast("string").alias("first_seen_seq")]


def _first_seen(df: DataFrame, key: str, kind: str) -> DataFrame:
    return (df.groupBy(key).agg(F.min(order_number()).alias("_f"))
              .select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("value"),
                      *_first_seen_columns()))


def filter_options(df: DataFrame) -> DataFrame:
    """Choices of the category, store and product pickers.

    Categories and stores come from the whole table in one pass (grouping
    sets: the scan feeds one partial hash aggregation keyed by either
    column), products from the latest snapshot.  The first-seen position is
    the minimum of the packed (date, row sequence) number.  Each value carries its first-seen
    position (date, and the row sequence as text) so a client can list them
    in first-seen order.
    """
    both = (df.groupingSets([[S.CATEGORY], [S.STORE]], S.CATEGORY, S.STORE)
              .agg(F.min(order_number()).alias("_f"),
                   F.grouping(S.CATEGORY).alias("_by_store")))
    is_store = F.col("_by_store") == 1
    dims_part = both.select(
        F.when(is_store, F.lit("store")).otherwise(F.lit("category")).alias("kind"),
        F.when(is_store, F.col(S.STORE)).otherwise(F.col(S.CATEGORY)).cast("string").alias("value"),
        *_first_seen_columns())
    return dims_part.unionByName(_first_seen(latest_snapshot(df), S.PRODUCT, "product"))


def snapshot_kpis(df: DataFrame, category: str | None = None,
                  store: str | None = None) -> DataFrame:
    """One row of snapshot KPIs for the scope.

    Distinct products count a missing id once (as the dashboard's
    ``len(unique())`` does).
    """
    snap = latest_snapshot(df, category, store)
    null_id = F.coalesce(F.max(F.col(S.PRODUCT).isNull().cast("int")), F.lit(0))
    return snap.agg(
        F.max(S.OBS_DATE).alias("latest_date"),
        (F.count_distinct(S.PRODUCT) + null_id).cast("bigint").alias("product_count"),
        F.coalesce(F.sum(S.INV), F.lit(0.0)).alias("total_stock"),
        round_half_even(F.avg(S.SOLD), 6).alias("avg_daily_sales"),
        F.coalesce(money_sum(F.col(S.INV) * F.col(S.PRICE)), F.lit(0.0)).alias("total_value"),
        F.count(F.lit(1)).alias("snapshot_rows"),
    )


def snapshot_category_stock(df: DataFrame, category: str | None = None,
                            store: str | None = None) -> DataFrame:
    """P5: snapshot stock per category, ascending."""
    snap = latest_snapshot(df, category, store).where(F.col(S.CATEGORY).isNotNull())
    return (snap.groupBy(S.CATEGORY)
                .agg(F.coalesce(F.sum(S.INV), F.lit(0.0)).alias("total_stock"))
                .orderBy(F.col("total_stock").asc(), F.col(S.CATEGORY)))


def _days_left(inv, sold):
    """stock / sales when sales > 0; NULL stands for 'infinite'."""
    return F.when(sold > 0, F.try_divide(inv, sold))


def top_sellers(df: DataFrame, n: int = 10, category: str | None = None,
                store: str | None = None, order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """The ``n`` snapshot rows with the highest sales (ties: file order; missing sales last)."""
    snap = latest_snapshot(df, category, store)
    rows = snap.select(*with_order_cols(S.PRODUCT, S.CATEGORY, S.SOLD, S.INV, S.STORE, order_cols=order_cols))
    keys = [F.col(S.SOLD).desc_nulls_last(), *order_keys(order_cols)]
    return top_n(rows, keys, n).select(
        "rank", S.PRODUCT, S.CATEGORY, S.SOLD, S.INV, S.STORE,
        _days_left(F.col(S.INV), F.col(S.SOLD)).alias("days_left"))


def highest_stock(df: DataFrame, n: int = 5, category: str | None = None,
                  store: str | None = None, order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """The ``n`` snapshot rows with the most stock (ties: file order; missing stock last)."""
    snap = latest_snapshot(df, category, store)
    rows = snap.select(*with_order_cols(S.PRODUCT, S.CATEGORY, S.SOLD, S.INV, S.STORE, order_cols=order_cols))
    keys = [F.col(S.INV).desc_nulls_last(), *order_keys(order_cols)]
    return top_n(rows, keys, n).select("rank", S.PRODUCT, S.CATEGORY, S.SOLD, S.INV, S.STORE)


def product_labels(df: DataFrame, order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """Each product with the category of its first row."""
    return end_rows(df, S.PRODUCT, (), (S.CATEGORY,), order_cols=order_cols)


def product_detail(df: DataFrame, category: str | None = None, store: str | None = None,
                   order_cols: Sequence[str] = S.ORDER_COLS, with_category: bool = False) -> DataFrame:
    """P10: first snapshot row of every product in scope.

    ``with_category`` adds the category of that row, the product's label
    within the filtered snapshot.
    """
    snap = latest_snapshot(df, category, store)
    texts = (S.STORE, S.CATEGORY) if with_category else (S.STORE,)
    first = end_rows(snap, S.PRODUCT, (S.INV, S.SOLD, S.PRICE), texts, order_cols=order_cols)
    inv, sold = F.col(S.INV), F.col(S.SOLD)
    return first.select(
        S.PRODUCT, S.INV, S.SOLD,
        trunc_to_long(_days_left(inv, sold)).alias("days_left"),
        S.PRICE, (inv * F.col(S.PRICE)).alias("stock_value"), *texts)


def product_history_counts(df: DataFrame, category: str | None = None,
                           store: str | None = None, min_rows: int = 2) -> DataFrame:
    """Products with at least ``min_rows`` history rows in scope."""
    return (scope(df, category, store).where(F.col(S.PRODUCT).isNotNull())
            .groupBy(S.PRODUCT).agg(F.count(F.lit(1)).alias("history_rows"))
            .where(F.col("history_rows") >= min_rows))


def cover_verdict(df: DataFrame, category: str | None = None, store: str | None = None,
                  plenty_days: int = 14, good_days: int = 7,
                  order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """Stock-cover verdict for products shown with history.

    Whole units as the dashboard uses them: ``stock > 14*sales`` plenty,
    ``> 7*sales`` good, else low; days of stock ``int(stock/sales)``,
    NULL meaning infinite.  The product detail and the history gate are
    both keyed by product, so the join reuses their partitioning.
    """
    detail = end_rows(latest_snapshot(df, category, store), S.PRODUCT, (S.INV, S.SOLD),
                      order_cols=order_cols)
    gate = product_history_counts(df, category, store)
    stock = trunc_to_long(F.col(S.INV))
    sales = trunc_to_long(F.col(S.SOLD))
    j = detail.join(gate, S.PRODUCT).select(
        S.PRODUCT, stock.alias("stock_units"), sales.alias("daily_sales_units"), "history_rows")
    st, sa = F.col("stock_units"), F.col("daily_sales_units")
    return j.select(
        S.PRODUCT, "stock_units", "daily_sales_units", "history_rows",
        F.when(sa > 0, trunc_to_long(st / sa)).alias("days_of_stock"),
        F.when(st.isNull() | sa.isNull(), F.lit(None).cast("string"))
         .when(st > sa * plenty_days, F.lit("plenty"))
         .when(st > sa * good_days, F.lit("good"))
         .otherwise(F.lit("low")).alias("verdict"))
