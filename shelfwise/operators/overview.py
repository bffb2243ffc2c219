"""Overview reports H1-H14."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import schema as S
from shelfwise.functions import dims
from shelfwise.functions.exprs import MONEY, money_sum, order_keys, round_half_even, with_order_cols
from shelfwise.operators import metrics as M
from shelfwise.operators.common import DEFAULT_AS_OF, as_of_season, order_position, ranked, shared, top_n


def stock_health(df: DataFrame, critical: float = 7, warning: float = 14) -> DataFrame:
    """H1, H2, H4: one row of stock-health counts, total value, lead-time alerts.

    One pass with conditional counts (the dashboard scans once per bucket).
    Counts are of observations over all dates; a missing M1 is in no bucket.
    """
    d = F.col(M.DAYS)
    return df.agg(
        F.count_if(d <= critical).alias("critical_rows"),
        F.count_if((d > critical) & (d <= warning)).alias("warning_rows"),
        F.count_if(d > warning).alias("healthy_rows"),
        F.coalesce(money_sum(F.col(S.INV) * F.col(S.PRICE)), F.lit(0.0)).alias("total_value"),
        F.count_if(F.col(M.LT_RISK) == 1).alias("lead_time_alert_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def critical_items(df: DataFrame, n: int = 5, critical: float = 7,
                   order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """H3: the ``n`` rows with the fewest days of stock (M1 <= critical)."""
    rows = df.where(F.col(M.DAYS) <= critical).select(*with_order_cols(
        S.PRODUCT, S.CATEGORY, M.DAYS, S.INV, S.SOLD, M.TARGET, M.SUGGESTED, S.DELIVERY,
        S.VENDOR, order_cols=order_cols))
    keys = [F.col(M.DAYS).asc_nulls_last(), *order_keys(order_cols)]
    return top_n(rows, keys, n).select(
        "rank", S.PRODUCT, S.CATEGORY, M.DAYS, S.INV, S.SOLD, M.TARGET, M.SUGGESTED,
        S.DELIVERY, S.VENDOR)


def lead_time_alert_count(df: DataFrame) -> DataFrame:
    """H4 alone: rows below their reorder point."""
    return df.agg(F.count_if(F.col(M.LT_RISK) == 1).alias("lead_time_alert_rows"))


def lead_time_alerts(df: DataFrame, n: int = 3, order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """H5: first ``n`` rows (file order) below their reorder point.

    ``days_to_order = int(max(0, (rop - stock) / sales))``; zero sales give
    NULL (the dashboard would fail on an infinite value there).
    """
    q = F.try_divide(F.col(M.ROP) - F.col(S.INV), F.col(S.SOLD))
    rows = df.where(F.col(M.LT_RISK) == 1).select(
        *with_order_cols(S.PRODUCT, M.ROP, S.INV, S.SOLD, order_cols=order_cols))
    out = top_n(rows, order_keys(order_cols), n)
    return out.select(
        "rank", S.PRODUCT, M.ROP, S.INV, S.SOLD,
        F.when(q.isNotNull(), F.greatest(F.lit(0.0), q)).cast("bigint").alias("days_to_order"))


def category_weather_impact(df: DataFrame, as_of: str = DEFAULT_AS_OF,
                            min_abs: float = 2.0, with_order: bool = False,
                            order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """H6, H7: current-season multiplier and impact for every category present.

    One hash aggregation over the fact (row count and first-seen position
    per category, partial + final); the category lookup is then a join of
    two tiny tables.  A missing category is listed with the default multiplier
    and 0 rows, as equality never matches it.
    """
    season = as_of_season(as_of)
    per_cat = (df.groupBy(S.CATEGORY)
                 .agg(F.count(F.lit(1)).alias("_n"), F.min(order_position(order_cols)).alias("_first_seen"))
                 .withColumn(M.SEASON, season))
    sens = F.broadcast(dims.weather_sensitivity(df.sparkSession)).select(
        F.col("category").alias("_c"), F.col("season").alias("_s"),
        F.col("weather_multiplier").alias("_m"))
    joined = per_cat.join(sens, (F.col(S.CATEGORY) == F.col("_c")) & (F.col(M.SEASON) == F.col("_s")),
                          "left")
    mult = F.coalesce(F.col("_m"), dims.default_multiplier(F.col(M.SEASON)), F.lit(1.0))
    impact = (mult - F.lit(1.0)) * F.lit(100.0)
    out = joined.select(
        S.CATEGORY, M.SEASON, mult.alias(M.MULT), impact.alias("impact_pct"),
        F.when(F.col(S.CATEGORY).isNull(), F.lit(0)).otherwise(F.col("_n")).cast("bigint")
         .alias("row_count"),
        F.when(impact > 0, F.lit("increase")).otherwise(F.lit("decrease")).alias("direction"),
        "_first_seen",
    ).where(F.abs(F.col("impact_pct")) > F.lit(float(min_abs)))
    return out if with_order else out.drop("_first_seen")


def top_weather_impacts(df: DataFrame, as_of: str = DEFAULT_AS_OF, n: int = 3,
                        min_abs: float = 2.0, order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """H8: the ``n`` largest absolute impacts; ties keep first-seen order."""
    impacts = category_weather_impact(df, as_of, min_abs, True, order_cols).withColumn(
        "abs_impact_pct", F.abs(F.col("impact_pct")))
    keys = [F.col("abs_impact_pct").desc(), F.col("_first_seen").asc()]
    return top_n(impacts, keys, n).select(
        "rank", S.CATEGORY, M.SEASON, "impact_pct", "abs_impact_pct", "direction", "row_count")


def weather_impact_summary(df: DataFrame, as_of: str = DEFAULT_AS_OF, min_abs: float = 2.0,
                           significant: float = 10.0) -> DataFrame:
    """H9: one row; mean absolute impact over kept categories and its severity."""
    impacts = category_weather_impact(df, as_of, min_abs)
    avg_abs = F.avg(F.abs(F.col("impact_pct")))
    out = impacts.agg(F.count(F.lit(1)).alias("impacted_categories"), avg_abs.alias("_avg"))
    return out.select(
        as_of_season(as_of).alias(M.SEASON),
        "impacted_categories",
        round_half_even(F.col("_avg"), 6).alias("avg_abs_impact_pct"),
        F.when(F.col("impacted_categories") == 0, F.lit("minimal"))
         .when(F.col("_avg") > significant, F.lit("significant"))
         .otherwise(F.lit("mild")).alias("severity"),
    )


def _category_totals(df: DataFrame) -> DataFrame:
    """Per category: units, exact decimal value, distinct products.

    The distinct count plans as a two-level aggregation keyed first by
    (category, product) and then by category, both with map-side partial
    aggregation, so one dominant category does not land whole on one task.
    """
    return (df.where(F.col(S.CATEGORY).isNotNull())
              .groupBy(S.CATEGORY)
              .agg(F.coalesce(F.sum(S.INV), F.lit(0.0)).alias("total_units"),
                   F.coalesce(F.sum(F.col(M.VALUE).cast(MONEY)),
                              F.lit(0).cast("decimal(38,6)")).alias("_value_dec"),
                   F.count_distinct(S.PRODUCT).alias("product_count")))


def category_stock(df: DataFrame) -> DataFrame:
    """Stock units, stock value and distinct products per category."""
    return _category_totals(df).select(
        S.CATEGORY, "total_units", F.col("_value_dec").cast("double").alias("total_value"),
        "product_count")


def category_leaders(df: DataFrame) -> DataFrame:
    """Leading categories by value and by units, product lines, total.

    Ties go to the alphabetically first category (the grouped table is
    sorted by name in the dashboard); "product lines" are those of the first
    category by name.
    """
    totals = _category_totals(df)
    value = F.col("_value_dec")
    return totals.agg(
        F.min_by(S.CATEGORY, F.struct(-value, F.col(S.CATEGORY))).alias("top_value_category"),
        F.max(value).cast("double").alias("top_value"),
        F.min_by(S.CATEGORY, F.struct(-F.col("total_units"), F.col(S.CATEGORY)))
         .alias("top_units_category"),
        F.max("total_units").alias("top_units"),
        F.min_by("product_count", F.col(S.CATEGORY)).alias("first_category_products"),
        F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,6)")).cast("double")
         .alias("grand_total_value"),
    )


def category_share(df: DataFrame, by: str = "units") -> DataFrame:
    """Each category's share of units and of value, in percent, and its rank by either.

    Listed by units or, ``by="value"``, by value, both descending.  The ranks
    number one row per category.

    The grand totals are scalar subqueries over the (shared) category
    aggregate, so the fact is scanned once and nothing is joined.
    """
    totals = shared(_category_totals(df))
    all_units = totals.select(F.sum("total_units")).scalar()
    all_value = totals.select(F.sum("_value_dec").cast("double")).scalar()
    value = F.col("_value_dec").cast("double")
    out = totals.select(
        S.CATEGORY, "total_units", value.alias("total_value"),
        round_half_even(F.try_divide(F.col("total_units"), all_units) * F.lit(100.0), 6)
        .alias("unit_share_pct"),
        round_half_even(F.try_divide(value, all_value) * F.lit(100.0), 6)
        .alias("value_share_pct"),
    )
    for name, key in (("unit_rank", "total_units"), ("value_rank", "total_value")):
        out = ranked(out, [F.col(key).desc(), F.col(S.CATEGORY)], name)
    return out.orderBy("value_rank" if by == "value" else "unit_rank")
