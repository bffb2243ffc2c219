"""Seasonal (weather) guide W1-W7."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import schema as S
from shelfwise.functions import dims
from shelfwise.functions.exprs import MONEY, next_season, round_half_even
from shelfwise.operators import metrics as M
from shelfwise.operators.common import DEFAULT_AS_OF, as_of_season


def seasonal_items(df: DataFrame, season: str | None = None,
                   as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Rows whose category is seasonal in ``season`` (default: as-of season).

    A left-semi join against at most a handful of literal categories,
    broadcast, so the fact side is filtered in place.
    """
    s = F.lit(season) if season is not None else as_of_season(as_of)
    cats = F.broadcast(dims.seasonal_categories(df.sparkSession)).where(F.col("season") == s)
    return df.join(cats.select(F.col("category").alias("_cat")),
                   F.col(S.CATEGORY) == F.col("_cat"), "left_semi")


def seasonal_exposure(df: DataFrame, as_of: str = DEFAULT_AS_OF,
                      season: str | None = None) -> DataFrame:
    """Per season, the stock in its seasonal categories.

    Plan: one aggregation of the fact by category (partial + final), then the
    few category rows are expanded to their seasons through a literal
    (season, category) table and re-aggregated, and finally laid on the
    four-row season profile so that every season appears.  The fact table
    is read once and never duplicated per season.
    """
    spark = df.sparkSession
    sold, inv = F.col(S.SOLD), F.col(S.INV)
    ratio = F.when(sold > 0, F.try_divide(inv, sold))
    per_cat = (df.where(F.col(S.CATEGORY).isNotNull()).groupBy(S.CATEGORY).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.col(M.VALUE).cast(MONEY)).alias("_value"),
        F.sum(inv).alias("_units"),
        F.count_if(sold > 0).alias("_sellers"),
        F.sum(ratio).alias("_ratio_sum"),
        F.count(ratio).alias("_ratio_n")))
    per_season = (per_cat.join(F.broadcast(dims.seasonal_categories(spark)), S.CATEGORY)
                  .groupBy("season").agg(*[F.sum(c).alias(c) for c in
                                           ("_rows", "_value", "_units", "_sellers",
                                            "_ratio_sum", "_ratio_n")]))
    profile = dims.season_profile(spark).join(dims.seasons(spark), "season")
    out = profile.join(per_season, "season", "left")
    mean = F.try_divide(F.col("_ratio_sum"), F.col("_ratio_n"))
    rows = F.coalesce(F.col("_rows"), F.lit(0)).cast("bigint")
    sellers = F.coalesce(F.col("_sellers"), F.lit(0)).cast("bigint")
    status = (F.when(rows == 0, F.lit("none"))
              .when(sellers == 0, F.lit("no sales data"))
              .when(mean < 14, F.lit("action needed"))
              .when(mean < 30, F.lit("watch closely"))
              .otherwise(F.lit("looking good")))
    current = as_of_season(as_of)
    res = out.select(
        "season", "season_order", (F.col("season") == current).alias("is_current"),
        next_season(F.col("season")).alias("next_season"),
        "demand_change_pct", "hot_items", "hot_item_count",
        "season_label", "stock_up_in", "planning_hot_items", "tip",
        rows.alias("seasonal_rows"),
        F.coalesce(F.col("_value"), F.lit(0).cast("decimal(38,2)")).cast("double")
         .alias("seasonal_value"),
        F.coalesce(F.col("_units"), F.lit(0.0)).alias("seasonal_units"),
        sellers.alias("seller_rows"),
        round_half_even(mean, 6).alias("avg_days_left"),
        status.alias("cover_status"))
    if season is not None:
        res = res.where(F.col("season") == F.lit(season))
    return res.orderBy("season_order")


def category_outlook(df: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Every category present x four seasons with the demand outlook.

    Categories without an outlook get the generic fallback text.  Each
    distinct category (one aggregation) is expanded to the four seasons by
    exploding a literal array, then looked up in the 20-row outlook table.
    """
    spark = df.sparkSession
    cats = df.groupBy(S.CATEGORY).agg(F.count(F.lit(1)).alias("_n")).select(S.CATEGORY)
    grid = cats.select(S.CATEGORY, F.posexplode(F.array(*[F.lit(s) for s in dims.SEASONS]))
                       .alias("season_order", "season"))
    look = F.broadcast(dims.category_outlook(spark)).select(
        F.col("category").alias("_c"), F.col("season").alias("_s"),
        "outlook_pct", "outlook_reason", "outlook")
    j = grid.join(look, (F.col(S.CATEGORY) == F.col("_c")) & (F.col("season") == F.col("_s")),
                  "left")
    return j.select(
        S.CATEGORY, "season", "season_order",
        (F.col("season") == as_of_season(as_of)).alias("is_current"),
        F.col("_c").isNotNull().alias("has_outlook"),
        "outlook_pct", "outlook_reason",
        F.coalesce(F.col("outlook"), F.lit(dims.OUTLOOK_FALLBACK)).alias("outlook"))
