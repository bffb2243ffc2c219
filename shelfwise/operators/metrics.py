"""Row metrics M1-M16 and ``enrich``.

All metrics are row-local expressions, the lookup of the built-in weather
multipliers included.  ``enrich`` therefore adds no join or shuffle and works
unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import schema as S
from shelfwise.functions import dims
from shelfwise.functions.exprs import season_of_month, strict_greatest

DAYS = "days_to_stockout"
RISK = "stockout_risk"
STATUS = "stock_status"
STATUS_RANK = "stock_status_rank"
DAILY = "daily_sales"
VALUE = "total_value"
LEAD = "procurement_lead_time"
SAFETY = "safety_stock_days"
ROP = "reorder_point"
LT_RISK = "lead_time_risk"
TARGET = "target_stock_level"
SUGGESTED = "suggested_order_qty"
MONTH = "month"
SEASON = "season"
MULT = "weather_multiplier"
ADJ_DEMAND = "weather_adjusted_demand"
IMPACT = "weather_impact_score"

ENRICHED_COLUMNS = (DAYS, RISK, STATUS, STATUS_RANK, DAILY, VALUE, LEAD, SAFETY, ROP,
                    LT_RISK, TARGET, SUGGESTED, MONTH, SEASON, MULT, ADJ_DEMAND, IMPACT)


def _flag(cond) -> F.Column:
    """0/1 flag where a missing operand counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def with_days_to_stockout(df: DataFrame) -> DataFrame:
    """M1: ceil(stock / sales), sales <= 0 or missing counting as 1."""
    sold = F.col(S.SOLD)
    divisor = F.when(sold > 0, sold).otherwise(F.lit(1.0))
    return df.withColumn(DAYS, F.ceil(F.col(S.INV) / divisor).cast("double"))


def with_stockout_risk(df: DataFrame) -> DataFrame:
    """M2: 1 when stock is below the demand forecast."""
    return df.withColumn(RISK, _flag(F.col(S.INV) < F.col(S.FORECAST)))


def with_stock_status(df: DataFrame, critical: float = 7, warning: float = 14) -> DataFrame:
    """M3: right-closed bins of M1; missing days give a missing status."""
    d = F.col(DAYS)
    return df.withColumns({
        STATUS: (F.when(d <= critical, F.lit("Critical"))
                 .when(d <= warning, F.lit("Warning"))
                 .when(d > warning, F.lit("Good"))),
        STATUS_RANK: (F.when(d <= critical, F.lit(0))
                      .when(d <= warning, F.lit(1))
                      .when(d > warning, F.lit(2))),
    })


def with_daily_sales(df: DataFrame) -> DataFrame:
    """M4."""
    return df.withColumn(DAILY, F.col(S.SOLD))


def with_total_value(df: DataFrame) -> DataFrame:
    """M5: stock x price."""
    return df.withColumn(VALUE, F.col(S.INV) * F.col(S.PRICE))


def with_lead_time(df: DataFrame) -> DataFrame:
    """M6."""
    return df.withColumn(LEAD, F.col(S.DELIVERY))


def with_safety_stock(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """M7: lead time x factor."""
    return df.withColumn(SAFETY, F.col(LEAD) * F.lit(float(factor)))


def with_reorder_point(df: DataFrame) -> DataFrame:
    """M8: sales x (lead time + safety days)."""
    return df.withColumn(ROP, F.col(S.SOLD) * (F.col(LEAD) + F.col(SAFETY)))


def with_lead_time_risk(df: DataFrame) -> DataFrame:
    """M9: 1 when stock is below the reorder point."""
    return df.withColumn(LT_RISK, _flag(F.col(S.INV) < F.col(ROP)))


def with_target_stock(df: DataFrame, days: float = 30) -> DataFrame:
    """Sales x days + reorder point."""
    return df.withColumn(TARGET, F.col(S.SOLD) * F.lit(float(days)) + F.col(ROP))


def with_suggested_order(df: DataFrame, critical: float = 7, min_days: float = 14) -> DataFrame:
    """Order up to target when critical, else max(rop - stock, min_days of sales).

    Uses the NULL-propagating maximum; a missing days value takes the
    non-critical branch (its comparison is false).
    """
    inv, sold = F.col(S.INV), F.col(S.SOLD)
    gap = F.when(F.col(DAYS) <= critical, F.col(TARGET) - inv).otherwise(
        strict_greatest(F.col(ROP) - inv, sold * F.lit(float(min_days))))
    return df.withColumn(SUGGESTED, strict_greatest(F.lit(0.0), gap))


def with_season(df: DataFrame) -> DataFrame:
    """Month and season of the observation date."""
    return (df.withColumn(MONTH, F.month(F.col(S.OBS_DATE)))
              .withColumn(SEASON, season_of_month(F.col(MONTH))))


def with_weather(df: DataFrame, sensitivity: DataFrame | None = None) -> DataFrame:
    """Category x season multiplier, adjusted demand, impact score.

    Unknown category -> default multiplier of the season; unknown season -> 1.0.
    The built-in table is a literal expression, which a report that doesn't use
    it drops.  A caller's table is joined, by Spark's size-checked choice; its
    (category, season) must be unique, or rows would be multiplied.
    """
    if sensitivity is None:
        return _impact(df.withColumn(MULT, F.coalesce(
            dims.multiplier(F.col(S.CATEGORY), F.col(SEASON)), dims.default_multiplier(F.col(SEASON)), F.lit(1.0))))
    twice = sensitivity.groupBy("category", "season").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one weather multiplier for {twice[0][0]}, {twice[0][1]}")
    lookup = sensitivity.select(
        F.col("category").alias("_w_category"), F.col("season").alias("_w_season"),
        F.col("weather_multiplier").alias("_w_mult"))
    joined = df.join(lookup, (F.col(S.CATEGORY) == F.col("_w_category"))
                     & (F.col(SEASON) == F.col("_w_season")), "left")
    mult = F.coalesce(F.col("_w_mult"), dims.default_multiplier(F.col(SEASON)), F.lit(1.0))
    return _impact(joined.withColumn(MULT, mult).drop("_w_category", "_w_season", "_w_mult"))


def _impact(df: DataFrame) -> DataFrame:
    return df.withColumns({ADJ_DEMAND: F.col(S.FORECAST) * F.col(MULT),
                           IMPACT: (F.col(MULT) - F.lit(1.0)) * F.lit(100.0)})


def enrich(df: DataFrame, sensitivity: DataFrame | None = None) -> DataFrame:
    """All sixteen derived columns (M1-M16) on an inventory table."""
    S.validate_schema(df)
    out = with_days_to_stockout(df)
    out = with_stockout_risk(out)
    out = with_stock_status(out)
    out = with_daily_sales(out)
    out = with_total_value(out)
    out = with_lead_time(out)
    out = with_safety_stock(out)
    out = with_reorder_point(out)
    out = with_lead_time_risk(out)
    out = with_target_stock(out)
    out = with_suggested_order(out)
    out = with_season(out)
    return with_weather(out, sensitivity)
