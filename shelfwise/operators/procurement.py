"""Order manager (procurement) reports L1-L12."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import schema as S
from shelfwise.functions.dims import URGENCY_STATUSES
from shelfwise.functions.exprs import MONEY, ladder, order_keys, with_order_cols
from shelfwise.operators.common import end_rows, top_n

DAYS_LEFT = "days_left"
URGENCY = "urgency"
TODAY, THIS_WEEK, SOON, GOOD = URGENCY_STATUSES


def selling_items(df: DataFrame) -> DataFrame:
    """L1: rows with sales (missing sales dropped)."""
    return df.where(F.col(S.SOLD) > 0)


def with_days_left(df: DataFrame) -> DataFrame:
    """L2: stock / sales rounded half-even to whole days (14.5 -> 14)."""
    return df.withColumn(DAYS_LEFT, F.rint(F.try_divide(F.col(S.INV), F.col(S.SOLD))))


def with_urgency(df: DataFrame, thresholds: Sequence[float] = (3, 7, 14)) -> DataFrame:
    """L3: urgency ladder on days left; missing days are 'Good for Now'."""
    steps = list(zip(thresholds, URGENCY_STATUSES[:3]))
    return df.withColumn(URGENCY, ladder(DAYS_LEFT, steps, otherwise=GOOD))


def order_items(df: DataFrame, thresholds: Sequence[float] = (3, 7, 14)) -> DataFrame:
    """L1-L3 together: selling rows with days left and urgency."""
    return with_urgency(with_days_left(selling_items(df)), thresholds)


def urgency_counts(df: DataFrame) -> DataFrame:
    """L4: rows per urgency status; all four statuses are always present.

    One pass of conditional counts gives a single row, which is turned into
    four rows by exploding a literal array (no join, no empty-group gaps).
    """
    items = order_items(df)
    one = items.agg(*[F.count_if(F.col(URGENCY) == s).alias(f"_n{i}")
                      for i, s in enumerate(URGENCY_STATUSES)])
    parts = [F.struct(F.lit(i).alias("status_rank"), F.lit(s).alias(URGENCY),
                      F.col(f"_n{i}").alias("item_count"))
             for i, s in enumerate(URGENCY_STATUSES)]
    return one.select(F.inline(F.array(*parts)))


def _order_list(df: DataFrame, status: str, n: int, days: float, order_cols: Sequence[str]) -> DataFrame:
    items = order_items(df).where(F.col(URGENCY) == status)
    rows = items.select(*with_order_cols(S.PRODUCT, S.INV, DAYS_LEFT, S.SOLD, S.PRICE, order_cols=order_cols))
    keys = [F.col(DAYS_LEFT).asc_nulls_last(), *order_keys(order_cols)]
    qty = F.col(S.SOLD) * F.lit(float(days))
    return top_n(rows, keys, n).select(
        "rank", S.PRODUCT, S.INV, DAYS_LEFT, S.SOLD, S.PRICE,
        qty.alias("order_qty"), (qty * F.col(S.PRICE)).alias("order_cost"))


def order_today(df: DataFrame, n: int = 5, days: float = 30,
                order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """The ``n`` most urgent 'Order Today!' rows with a 30-day order."""
    return _order_list(df, TODAY, n, days, order_cols)


def order_this_week(df: DataFrame, n: int = 10, days: float = 30,
                    order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """The ``n`` most urgent 'Order This Week' rows with a 30-day order."""
    return _order_list(df, THIS_WEEK, n, days, order_cols)


def vendor_speed(df: DataFrame) -> DataFrame:
    """Mean delivery days per vendor over selling rows, fastest first."""
    return (selling_items(df).where(F.col(S.VENDOR).isNotNull())
            .groupBy(S.VENDOR).agg(F.avg(S.DELIVERY).alias("avg_delivery_days"))
            .orderBy(F.col("avg_delivery_days").asc_nulls_last(), F.col(S.VENDOR)))


def vendor_speed_extremes(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` fastest and the ``n`` slowest vendors.

    Two top-N selections over the vendor aggregate (whose shuffle is reused);
    rank 1 is the fastest in 'fastest' and the slowest in 'slowest'.
    """
    speed = vendor_speed(df)
    avg = F.col("avg_delivery_days")
    fast = top_n(speed, [avg.asc_nulls_last(), F.col(S.VENDOR).asc()], n)
    slow = top_n(speed, [avg.desc_nulls_first(), F.col(S.VENDOR).desc()], n)
    return (fast.withColumn("speed_group", F.lit("fastest"))
            .unionByName(slow.withColumn("speed_group", F.lit("slowest")))
            .select("speed_group", "rank", S.VENDOR, "avg_delivery_days"))


def order_budget(df: DataFrame, days: float = 30) -> DataFrame:
    """Money for today's and this week's 30-day orders (gross of stock)."""
    items = order_items(df)
    cost = (F.col(S.SOLD) * F.lit(float(days))) * F.col(S.PRICE)
    money = cost.cast(MONEY)
    today = F.sum(F.when(F.col(URGENCY) == TODAY, money))
    week = F.sum(F.when(F.col(URGENCY) == THIS_WEEK, money))
    zero = F.lit(0).cast("decimal(38,6)")
    return items.agg(F.coalesce(today, zero).alias("_t"), F.coalesce(week, zero).alias("_w")).select(
        F.col("_t").cast("double").alias("today_budget"),
        F.col("_w").cast("double").alias("week_budget"),
        (F.col("_t") + F.col("_w")).cast("double").alias("total_budget"))


def product_order_status(df: DataFrame, which: str = "first", thresholds: Sequence[float] = (3, 7, 14),
                         order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """First (or last) selling row of every product with days left and urgency."""
    rows = end_rows(selling_items(df), S.PRODUCT, (S.INV, S.SOLD, S.PRICE), which=which, order_cols=order_cols)
    return with_urgency(with_days_left(rows), thresholds)


def coverage_plan(df: DataFrame, coverages: Sequence[int] = (14, 21, 30, 45, 60),
                  which: str = "first", order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """Order needed for each coverage option, its cost and advice.

    ``need = max(0, sales * coverage - stock)`` (a missing operand gives 0).
    Five rows per product from exploding a literal array.
    """
    status = product_order_status(df, which, order_cols=order_cols)
    cov = F.explode(F.array(*[F.lit(int(c)) for c in coverages])).alias("coverage_days")
    rows = status.select("*", cov)
    target = F.col(S.SOLD) * F.col("coverage_days")
    need = F.greatest(F.lit(0.0), target - F.col(S.INV))
    advice = (F.when(F.col("order_needed") > 0,
                     ladder(DAYS_LEFT, [(3, "Order immediately"), (7, "Order this week")],
                            otherwise="Plan ahead"))
              .otherwise(F.lit("No order needed")))
    return (rows.select(S.PRODUCT, "coverage_days", DAYS_LEFT, target.alias("target_stock"),
                        need.alias("order_needed"), S.PRICE)
                .withColumn("order_cost", F.col("order_needed") * F.col(S.PRICE))
                .withColumn("advice", advice)
                .drop(S.PRICE, DAYS_LEFT))
