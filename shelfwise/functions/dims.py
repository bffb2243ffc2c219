"""Fixed lookup tables of the dashboard as small DataFrames.

Each table is built from literal rows (a LocalRelation of at most a few dozen
rows), so broadcasting it is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEASONS = ("Winter", "Spring", "Summer", "Fall")

# ---------------------------------------------------------------------------
# Fixed values (must equal the dashboard's for identical results).
# ---------------------------------------------------------------------------

# Category x season demand multiplier.
WEATHER_SENSITIVITY = {
    "Electronics": {"Winter": 1.2, "Spring": 1.0, "Summer": 1.1, "Fall": 1.0},
    "Clothing": {"Winter": 1.4, "Spring": 1.1, "Summer": 0.8, "Fall": 1.2},
    "Toys": {"Winter": 1.3, "Spring": 1.0, "Summer": 1.5, "Fall": 1.1},
    "Furniture": {"Winter": 0.9, "Spring": 1.3, "Summer": 1.2, "Fall": 1.0},
    "Groceries": {"Winter": 1.1, "Spring": 1.0, "Summer": 0.95, "Fall": 1.05},
}

# Multiplier for a category missing from the table above; an unknown season
# gets 1.0.
DEFAULT_SEASON_MULTIPLIER = {"Winter": 1.1, "Spring": 1.0, "Summer": 1.2, "Fall": 1.0}

# Categories counted as seasonal in each season.
SEASONAL_CATEGORIES = {
    "Summer": ["Toys", "Electronics", "Furniture"],
    "Winter": ["Clothing", "Electronics", "Toys"],
    "Spring": ["Furniture", "Groceries"],
    "Fall": ["Clothing", "Electronics"],
}

# Season profile: expected demand change (percent) and hot items.
SEASON_PROFILE = {
    "Summer": (25, ["Toys", "Electronics (AC/Fans)", "Outdoor Furniture", "Summer Clothing"]),
    "Winter": (15, ["Clothing", "Electronics (Heaters)", "Holiday Items", "Comfort Products"]),
    "Fall": (10, ["Clothing", "Electronics", "School Supplies", "Furniture"]),
    "Spring": (5, ["Furniture", "Home Improvement", "Gardening", "Cleaning Products"]),
}

# Seasonal planning guide: season label, stock-up window, hot items, tip.
PLANNING_GUIDE = {
    "Spring": ("Spring (Mar-May)", "January-February",
               "Furniture, Home improvement, Gardening supplies",
               "People clean and redecorate homes"),
    "Summer": ("Summer (Jun-Aug)", "April-May",
               "Toys, Outdoor furniture, Cooling electronics",
               "Kids on vacation, hot weather needs"),
    "Fall": ("Fall (Sep-Nov)", "July-August",
             "Clothing, Electronics, Back-to-school items",
             "Back to school and preparing for winter"),
    "Winter": ("Winter (Dec-Feb)", "October-November",
               "Clothing, Electronics, Holiday gifts",
               "Cold weather and holiday shopping"),
}

# Category x season demand outlook (percent change, reason).
CATEGORY_OUTLOOK = {
    "Electronics": {
        "Summer": "+10% (Air conditioning, fans)",
        "Winter": "+20% (Heaters, holiday gifts)",
        "Spring": "Normal (Steady demand)",
        "Fall": "+15% (Back to school, new models)",
    },
    "Clothing": {
        "Summer": "-20% (Less layers needed)",
        "Winter": "+40% (Warm clothes needed)",
        "Spring": "+10% (New season wardrobe)",
        "Fall": "+20% (Back to school, layers)",
    },
    "Toys": {
        "Summer": "+30% (Kids on vacation)",
        "Winter": "+25% (Holiday gifts)",
        "Spring": "Normal (Steady demand)",
        "Fall": "+10% (Back to school)",
    },
    "Furniture": {
        "Summer": "+20% (Outdoor furniture)",
        "Winter": "-10% (Less moving/decorating)",
        "Spring": "+30% (Spring cleaning, redecorating)",
        "Fall": "Normal (Steady demand)",
    },
    "Groceries": {
        "Summer": "-5% (People eat out more)",
        "Winter": "+5% (More home cooking)",
        "Spring": "Normal (Steady demand)",
        "Fall": "Normal (Steady demand)",
    },
}
OUTLOOK_FALLBACK = "most products see +10-15% increase during peak seasons"

# Urgency statuses of the order manager, most urgent first.
URGENCY_STATUSES = ("Order Today!", "Order This Week", "Order Soon", "Good for Now")

# Supplier recommendation texts, one per sub-score below 70.
VENDOR_RECOMMENDATIONS = {
    "delivery": "Delivery: Consider negotiating faster delivery options",
    "volume": "Volume: Explore bulk ordering opportunities",
    "reliability": "Reliability: Monitor stock levels more closely",
}

# ---------------------------------------------------------------------------


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A LocalRelation of literal rows (SQL ``VALUES``).

    Unlike ``createDataFrame`` on a Python list (an RDD scan of unknown
    size), a LocalRelation carries exact statistics, so Catalyst sees that
    it is tiny and broadcasts it without a hint, and no Python data is
    shipped at execution time.
    """
    cols = [c.strip().split(" ", 1) for c in ddl.split(",")]

    def lit(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"CAST({v!r} AS {t})"

    values = ", ".join("(" + ", ".join(lit(v, t) for v, (_, t) in zip(r, cols)) + ")" for r in rows)
    names = ", ".join(n for n, _ in cols)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def _outlook_pct(text: str) -> int:
    head = text.split(" ", 1)[0]
    return 0 if head == "Normal" else int(head.rstrip("%"))


def _outlook_reason(text: str) -> str:
    return text[text.index("(") + 1:text.rindex(")")]


def weather_sensitivity(spark: SparkSession) -> DataFrame:
    """(category, season, weather_multiplier): 20 rows."""
    rows = [(c, s, float(m)) for c, by in WEATHER_SENSITIVITY.items() for s, m in by.items()]
    return literal_table(spark, rows, "category string, season string, weather_multiplier double")


def seasonal_categories(spark: SparkSession) -> DataFrame:
    """(season, category): 10 rows."""
    rows = [(s, c) for s, cats in SEASONAL_CATEGORIES.items() for c in cats]
    return literal_table(spark, rows, "season string, category string")


def season_profile(spark: SparkSession) -> DataFrame:
    """One row per season with its profile and planning guide."""
    rows = []
    for s in SEASONS:
        pct, hot = SEASON_PROFILE[s]
        label, window, guide_hot, tip = PLANNING_GUIDE[s]
        rows.append((s, pct, ", ".join(hot), len(hot), label, window, guide_hot, tip))
    return literal_table(
        spark, rows,
        "season string, demand_change_pct int, hot_items string, hot_item_count int, "
        "season_label string, stock_up_in string, planning_hot_items string, tip string")


def category_outlook(spark: SparkSession) -> DataFrame:
    """(category, season, outlook_pct, outlook_reason, outlook): 20 rows."""
    rows = [(c, s, _outlook_pct(t), _outlook_reason(t), t)
            for c, by in CATEGORY_OUTLOOK.items() for s, t in by.items()]
    return literal_table(
        spark, rows, "category string, season string, outlook_pct int, outlook_reason string, outlook string")


def seasons(spark: SparkSession) -> DataFrame:
    """(season, season_order): the four seasons."""
    return literal_table(spark, [(s, i) for i, s in enumerate(SEASONS)],
                         "season string, season_order int")


def multiplier(category, season):
    """The weather multiplier as an expression; NULL if the table has none."""
    out = F.lit(None).cast("double")
    for name, by in WEATHER_SENSITIVITY.items():
        one = F.lit(None).cast("double")
        for s, value in by.items():
            one = F.when(season == s, F.lit(value)).otherwise(one)
        out = F.when(category == name, one).otherwise(out)
    return out


def default_multiplier(season_col) -> F.Column:
    """Multiplier of an unknown category by season; NULL for unknown season."""
    out = None
    for s, m in DEFAULT_SEASON_MULTIPLIER.items():
        cond = season_col == F.lit(s)
        out = F.when(cond, F.lit(float(m))) if out is None else out.when(cond, F.lit(float(m)))
    return out
