"""Reference SQL for every catalog query, runnable by DuckDB.

Each query is written independently of the Spark code: the inventory view
(``inv``) and the enriched view (``enr``) are common table expressions over
the driver's star-schema tables, and the report logic is plain SQL.
Conventions shared with the Spark side (so values compare bit for bit):
money is summed as DECIMAL(28,6) and returned as DOUBLE; counts are BIGINT;
non-exact ratios are rounded half-even to 6 places as ``rint(x*1e6)/1e6``;
Python ``int()`` is ``trunc`` (a DuckDB cast would round).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (the dashboard's, held here apart from the engine's own copy, so
# that a slip in either shows).
# ---------------------------------------------------------------------------

_SEASONS = ('Winter', 'Spring', 'Summer', 'Fall')
_SEASONAL_CATEGORIES = {'Summer': ['Toys', 'Electronics', 'Furniture'],
 'Winter': ['Clothing', 'Electronics', 'Toys'],
 'Spring': ['Furniture', 'Groceries'],
 'Fall': ['Clothing', 'Electronics']}
_SEASON_PROFILE = {'Summer': (25, ['Toys', 'Electronics (AC/Fans)', 'Outdoor Furniture', 'Summer Clothing']),
 'Winter': (15, ['Clothing', 'Electronics (Heaters)', 'Holiday Items', 'Comfort Products']),
 'Fall': (10, ['Clothing', 'Electronics', 'School Supplies', 'Furniture']),
 'Spring': (5, ['Furniture', 'Home Improvement', 'Gardening', 'Cleaning Products'])}
_PLANNING_GUIDE = {'Spring': ('Spring (Mar-May)',
            'January-February',
            'Furniture, Home improvement, Gardening supplies',
            'People clean and redecorate homes'),
 'Summer': ('Summer (Jun-Aug)',
            'April-May',
            'Toys, Outdoor furniture, Cooling electronics',
            'Kids on vacation, hot weather needs'),
 'Fall': ('Fall (Sep-Nov)',
          'July-August',
          'Clothing, Electronics, Back-to-school items',
          'Back to school and preparing for winter'),
 'Winter': ('Winter (Dec-Feb)',
            'October-November',
            'Clothing, Electronics, Holiday gifts',
            'Cold weather and holiday shopping')}
_CATEGORY_OUTLOOK = {'Electronics': {'Summer': '+10% (Air conditioning, fans)',
                 'Winter': '+20% (Heaters, holiday gifts)',
                 'Spring': 'Normal (Steady demand)',
                 'Fall': '+15% (Back to school, new models)'},
 'Clothing': {'Summer': '-20% (Less layers needed)',
              'Winter': '+40% (Warm clothes needed)',
              'Spring': '+10% (New season wardrobe)',
              'Fall': '+20% (Back to school, layers)'},
 'Toys': {'Summer': '+30% (Kids on vacation)',
          'Winter': '+25% (Holiday gifts)',
          'Spring': 'Normal (Steady demand)',
          'Fall': '+10% (Back to school)'},
 'Furniture': {'Summer': '+20% (Outdoor furniture)',
               'Winter': '-10% (Less moving/decorating)',
               'Spring': '+30% (Spring cleaning, redecorating)',
               'Fall': 'Normal (Steady demand)'},
 'Groceries': {'Summer': '-5% (People eat out more)',
               'Winter': '+5% (More home cooking)',
               'Spring': 'Normal (Steady demand)',
               'Fall': 'Normal (Steady demand)'}}
_OUTLOOK_FALLBACK = 'most products see +10-15% increase during peak seasons'
_VENDOR_RECOMMENDATIONS = {'delivery': 'Delivery: Consider negotiating faster delivery options',
 'volume': 'Volume: Explore bulk ordering opportunities',
 'reliability': 'Reliability: Monitor stock levels more closely'}

ADAPTER_SQL = """
SELECT CAST(l.l_shipdate AS DATE) AS obs_date, r.r_name AS store_id, l.l_partkey AS product_id,
 CASE p.p_type WHEN 'ECONOMY' THEN 'Groceries' WHEN 'LARGE' THEN 'Furniture' WHEN 'MEDIUM' THEN 'Clothing'
   WHEN 'PROMO' THEN 'Toys' WHEN 'SMALL' THEN 'Electronics' ELSE 'Other' END AS category,
 CAST((l.l_partkey*7 + l.l_orderkey*13 + l.l_linenumber*31) % 501 AS DOUBLE) AS inventory_level,
 l.l_quantity - CAST(1 AS DOUBLE) AS units_sold,
 CAST((l.l_orderkey*17 + l.l_partkey*3) % 180 + 20 AS DOUBLE) AS units_ordered,
 CAST((CAST(l.l_quantity AS BIGINT) - 1) * 5 + l.l_partkey % 11 AS DOUBLE) AS demand_forecast,
 p.p_retailprice AS price, s.s_name AS vendor,
 CAST(1 + s.s_suppkey % 14 AS DOUBLE) AS vendor_avg_delivery_days,
 CAST(((CAST(l.l_orderkey AS DECIMAL(38,0))*8 + l.l_linenumber)*100000 + l.l_partkey)*10000 + l.l_suppkey
   AS DECIMAL(38,0)) AS row_seq
FROM lineitem l
JOIN orders o ON l.l_orderkey=o.o_orderkey
JOIN customer c ON o.o_custkey=c.c_custkey
JOIN nation n ON c.c_nationkey=n.n_nationkey
JOIN region r ON n.n_regionkey=r.r_regionkey
JOIN part p ON l.l_partkey=p.p_partkey
JOIN supplier s ON l.l_suppkey=s.s_suppkey
"""

_SEASON_CASE = """CASE WHEN {m} IN (12, 1, 2) THEN 'Winter' WHEN {m} IN (3, 4, 5) THEN 'Spring'
  WHEN {m} IN (6, 7, 8) THEN 'Summer' WHEN {m} IN (9, 10, 11) THEN 'Fall' END"""

_DEFAULT_MULT = """CASE {s} WHEN 'Winter' THEN CAST(1.1 AS DOUBLE) WHEN 'Spring' THEN CAST(1.0 AS DOUBLE)
  WHEN 'Summer' THEN CAST(1.2 AS DOUBLE) WHEN 'Fall' THEN CAST(1.0 AS DOUBLE) END"""

SENSITIVITY_SQL = """
SELECT * FROM (VALUES
 ('Electronics', 'Winter', 1.2), ('Electronics', 'Spring', 1.0), ('Electronics', 'Summer', 1.1), ('Electronics', 'Fall', 1.0),
 ('Clothing', 'Winter', 1.4), ('Clothing', 'Spring', 1.1), ('Clothing', 'Summer', 0.8), ('Clothing', 'Fall', 1.2),
 ('Toys', 'Winter', 1.3), ('Toys', 'Spring', 1.0), ('Toys', 'Summer', 1.5), ('Toys', 'Fall', 1.1),
 ('Furniture', 'Winter', 0.9), ('Furniture', 'Spring', 1.3), ('Furniture', 'Summer', 1.2), ('Furniture', 'Fall', 1.0),
 ('Groceries', 'Winter', 1.1), ('Groceries', 'Spring', 1.0), ('Groceries', 'Summer', 0.95), ('Groceries', 'Fall', 1.05)
) AS t(category, season, mult_text)
"""

ENRICH_CTES = f"""
inv AS ({ADAPTER_SQL}),
e1 AS (
 SELECT *,
  CAST(ceil(inventory_level / CASE WHEN units_sold > 0 THEN units_sold ELSE CAST(1 AS DOUBLE) END) AS DOUBLE)
    AS days_to_stockout,
  CAST(COALESCE(CAST(inventory_level < demand_forecast AS INTEGER), 0) AS INTEGER) AS stockout_risk,
  units_sold AS daily_sales,
  inventory_level * price AS total_value,
  vendor_avg_delivery_days AS procurement_lead_time,
  vendor_avg_delivery_days * CAST(1.5 AS DOUBLE) AS safety_stock_days,
  CAST(month(obs_date) AS INTEGER) AS month
 FROM inv),
e2 AS (
 SELECT *,
  units_sold * (procurement_lead_time + safety_stock_days) AS reorder_point,
  {_SEASON_CASE.format(m='month')} AS season,
  CASE WHEN days_to_stockout <= 7 THEN 'Critical' WHEN days_to_stockout <= 14 THEN 'Warning'
       WHEN days_to_stockout > 14 THEN 'Good' END AS stock_status,
  CAST(CASE WHEN days_to_stockout <= 7 THEN 0 WHEN days_to_stockout <= 14 THEN 1
       WHEN days_to_stockout > 14 THEN 2 END AS INTEGER) AS stock_status_rank
 FROM e1),
e3 AS (
 SELECT *,
  CAST(COALESCE(CAST(inventory_level < reorder_point AS INTEGER), 0) AS INTEGER) AS lead_time_risk,
  units_sold * CAST(30 AS DOUBLE) + reorder_point AS target_stock_level
 FROM e2),
e4 AS (
 SELECT *,
  CASE WHEN gap IS NULL THEN NULL ELSE greatest(CAST(0 AS DOUBLE), gap) END AS suggested_order_qty
 FROM (SELECT *,
   CASE WHEN days_to_stockout <= 7 THEN target_stock_level - inventory_level
        WHEN (reorder_point - inventory_level) IS NULL OR (units_sold * CAST(14 AS DOUBLE)) IS NULL THEN NULL
        ELSE greatest(reorder_point - inventory_level, units_sold * CAST(14 AS DOUBLE)) END AS gap
  FROM e3) g),
sens AS (SELECT category, season, CAST(mult_text AS DOUBLE) AS weather_multiplier FROM ({SENSITIVITY_SQL}) v),
e5 AS (
 SELECT e4.* EXCLUDE (gap),
  COALESCE(sens.weather_multiplier, {_DEFAULT_MULT.format(s='e4.season')}, CAST(1 AS DOUBLE)) AS weather_multiplier
 FROM e4 LEFT JOIN sens ON e4.category = sens.category AND e4.season = sens.season),
enr AS (
 SELECT *,
  demand_forecast * weather_multiplier AS weather_adjusted_demand,
  (weather_multiplier - CAST(1 AS DOUBLE)) * CAST(100 AS DOUBLE) AS weather_impact_score
 FROM e5)
"""


def _with(body: str, extra_ctes: str = "") -> str:
    ctes = ENRICH_CTES + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


def round6(expr: str) -> str:
    return f"(round_even(({expr}) * CAST(1000000 AS DOUBLE), 0) / CAST(1000000 AS DOUBLE))"


def money(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(28,6))) AS DOUBLE)"


def int_of(expr: str) -> str:
    return f"CAST(trunc({expr}) AS BIGINT)"


ORDER = "obs_date NULLS LAST, row_seq NULLS LAST"
AS_OF_SEASON = "'Summer'"  # season of the default as-of date 2025-08-07


SQL: dict[str, str] = {}

SQL["m_enrich"] = _with("SELECT * REPLACE (CAST(row_seq AS VARCHAR) AS row_seq) FROM enr")

SQL["h1_stock_health"] = _with(f"""
SELECT CAST(count_if(days_to_stockout <= 7) AS BIGINT) AS critical_rows,
 CAST(count_if(days_to_stockout > 7 AND days_to_stockout <= 14) AS BIGINT) AS warning_rows,
 CAST(count_if(days_to_stockout > 14) AS BIGINT) AS healthy_rows,
 COALESCE({money('inventory_level * price')}, CAST(0 AS DOUBLE)) AS total_value,
 CAST(count_if(lead_time_risk = 1) AS BIGINT) AS lead_time_alert_rows,
 CAST(count(*) AS BIGINT) AS total_rows
FROM enr""")

# ---------------------------------------------------------------------------
# Overview
# ---------------------------------------------------------------------------


AS_OF = "DATE '2025-08-07'"
CUR_SEASON = _SEASON_CASE.format(m=f"month({AS_OF})")
FIRST_SEEN = "min({'d': obs_date, 's': row_seq, 'u': units_sold})"

IMPACTS_CTE = f"""
per_cat AS (SELECT category, count(*) AS n, {FIRST_SEEN} AS first_seen FROM enr GROUP BY category),
imp0 AS (
 SELECT pc.category, {CUR_SEASON} AS season, pc.n, pc.first_seen,
  COALESCE(sens.weather_multiplier, {_DEFAULT_MULT.format(s=CUR_SEASON)}, CAST(1 AS DOUBLE)) AS weather_multiplier
 FROM per_cat pc LEFT JOIN sens ON pc.category = sens.category AND sens.season = {CUR_SEASON}),
impacts AS (
 SELECT category, season, weather_multiplier,
  (weather_multiplier - CAST(1 AS DOUBLE)) * CAST(100 AS DOUBLE) AS impact_pct,
  CAST(CASE WHEN category IS NULL THEN 0 ELSE n END AS BIGINT) AS row_count,
  CASE WHEN (weather_multiplier - CAST(1 AS DOUBLE)) * CAST(100 AS DOUBLE) > 0 THEN 'increase' ELSE 'decrease' END
    AS direction,
  first_seen
 FROM imp0
 WHERE abs((weather_multiplier - CAST(1 AS DOUBLE)) * CAST(100 AS DOUBLE)) > CAST(2 AS DOUBLE))
"""

SQL["h3_critical_items"] = _with(f"""
SELECT CAST(row_number() OVER (ORDER BY days_to_stockout, {ORDER}) AS INTEGER) AS rank,
 product_id, category, days_to_stockout, inventory_level, units_sold, target_stock_level,
 suggested_order_qty, vendor_avg_delivery_days, vendor
FROM enr WHERE days_to_stockout <= 7
ORDER BY rank LIMIT 5""")

SQL["h5_lead_time_alerts"] = _with(f"""
SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS rank,
 product_id, reorder_point, inventory_level, units_sold,
 CASE WHEN units_sold <> 0 AND (reorder_point - inventory_level) IS NOT NULL
  THEN {int_of('greatest(CAST(0 AS DOUBLE), (reorder_point - inventory_level) / units_sold)')} END
  AS days_to_order
FROM enr WHERE lead_time_risk = 1
ORDER BY rank LIMIT 3""")

SQL["h7_category_weather_impact"] = _with(
    "SELECT category, season, weather_multiplier, impact_pct, row_count, direction FROM impacts",
    IMPACTS_CTE)

SQL["h8_top_weather_impacts"] = _with("""
SELECT CAST(row_number() OVER (ORDER BY abs(impact_pct) DESC, first_seen) AS INTEGER) AS rank,
 category, season, impact_pct, abs(impact_pct) AS abs_impact_pct, direction, row_count
FROM impacts ORDER BY rank LIMIT 3""", IMPACTS_CTE)

SQL["h9_weather_summary"] = _with(f"""
SELECT {CUR_SEASON} AS season, CAST(count(*) AS BIGINT) AS impacted_categories,
 {round6('avg(abs(impact_pct))')} AS avg_abs_impact_pct,
 CASE WHEN count(*) = 0 THEN 'minimal' WHEN avg(abs(impact_pct)) > 10 THEN 'significant' ELSE 'mild' END
  AS severity
FROM impacts""", IMPACTS_CTE)

CATEGORY_CTE = """
ct AS (
 SELECT category, COALESCE(SUM(inventory_level), CAST(0 AS DOUBLE)) AS total_units,
  COALESCE(SUM(CAST(total_value AS DECIMAL(28,6))), 0) AS value_dec,
  CAST(count(DISTINCT product_id) AS BIGINT) AS product_count
 FROM enr WHERE category IS NOT NULL GROUP BY category)
"""

SQL["h10_category_stock"] = _with(
    "SELECT category, total_units, CAST(value_dec AS DOUBLE) AS total_value, product_count FROM ct",
    CATEGORY_CTE)

SQL["h11_category_leaders"] = _with("""
SELECT
 (SELECT category FROM ct ORDER BY value_dec DESC, category LIMIT 1) AS top_value_category,
 (SELECT CAST(max(value_dec) AS DOUBLE) FROM ct) AS top_value,
 (SELECT category FROM ct ORDER BY total_units DESC, category LIMIT 1) AS top_units_category,
 (SELECT max(total_units) FROM ct) AS top_units,
 (SELECT product_count FROM ct ORDER BY category LIMIT 1) AS first_category_products,
 (SELECT CAST(COALESCE(SUM(value_dec), 0) AS DOUBLE) FROM ct) AS grand_total_value""",
    CATEGORY_CTE)

SQL["h13_category_share"] = _with(f"""
SELECT category, total_units, CAST(value_dec AS DOUBLE) AS total_value,
 {round6('total_units / (SELECT SUM(total_units) FROM ct) * CAST(100 AS DOUBLE)')} AS unit_share_pct,
 {round6('CAST(value_dec AS DOUBLE) / (SELECT CAST(SUM(value_dec) AS DOUBLE) FROM ct) * CAST(100 AS DOUBLE)')}
  AS value_share_pct,
 row_number() OVER (ORDER BY total_units DESC, category) AS unit_rank,
 row_number() OVER (ORDER BY value_dec DESC, category) AS value_rank
FROM ct""", CATEGORY_CTE)
SQL["h14_value_share"] = SQL["h13_category_share"] + " ORDER BY value_rank"

# ---------------------------------------------------------------------------
# Products
# ---------------------------------------------------------------------------

SNAP_CTE = "snap AS (SELECT * FROM enr WHERE obs_date = (SELECT max(obs_date) FROM enr))"

SQL["p1_latest_snapshot"] = _with("""
SELECT obs_date, store_id, product_id, category, inventory_level, units_sold, price, total_value,
 vendor, days_to_stockout, stock_status
FROM snap""", SNAP_CTE)


def _first_seen_sql(col: str, kind: str, src: str) -> str:
    return f"""
SELECT '{kind}' AS kind, CAST({col} AS VARCHAR) AS value,
 struct_extract(f, 'd') AS first_seen_date, CAST(struct_extract(f, 's') AS VARCHAR) AS first_seen_seq
FROM (SELECT {col}, {FIRST_SEEN} AS f FROM {src} GROUP BY {col})"""


SQL["p3_filter_options"] = _with(
    _first_seen_sql("category", "category", "enr") + "\nUNION ALL" +
    _first_seen_sql("store_id", "store", "enr") + "\nUNION ALL" +
    _first_seen_sql("product_id", "product", "snap"), SNAP_CTE)

SQL["p4_snapshot_kpis"] = _with(f"""
SELECT max(obs_date) AS latest_date,
 CAST(count(DISTINCT product_id) + COALESCE(max(CAST(product_id IS NULL AS INTEGER)), 0) AS BIGINT)
  AS product_count,
 COALESCE(SUM(inventory_level), CAST(0 AS DOUBLE)) AS total_stock,
 {round6('avg(units_sold)')} AS avg_daily_sales,
 COALESCE({money('inventory_level * price')}, CAST(0 AS DOUBLE)) AS total_value,
 CAST(count(*) AS BIGINT) AS snapshot_rows
FROM snap""", SNAP_CTE)

SQL["p5_snapshot_category_stock"] = _with("""
SELECT category, COALESCE(SUM(inventory_level), CAST(0 AS DOUBLE)) AS total_stock
FROM snap WHERE category IS NOT NULL GROUP BY category""", SNAP_CTE)

SQL["p6_top_sellers"] = _with(f"""
SELECT CAST(row_number() OVER (ORDER BY units_sold DESC NULLS LAST, {ORDER}) AS INTEGER) AS rank,
 product_id, category, units_sold, inventory_level, store_id,
 CASE WHEN units_sold > 0 THEN inventory_level / units_sold END AS days_left
FROM snap ORDER BY rank LIMIT 10""", SNAP_CTE)

SQL["p8_highest_stock"] = _with(f"""
SELECT CAST(row_number() OVER (ORDER BY inventory_level DESC NULLS LAST, {ORDER}) AS INTEGER) AS rank,
 product_id, category, units_sold, inventory_level, store_id
FROM snap ORDER BY rank LIMIT 5""", SNAP_CTE)

SQL["p9_product_labels"] = _with("""
SELECT product_id,
 struct_extract(min({'d': obs_date, 's': row_seq, 'u': units_sold, 'c': category}), 'c') AS category
FROM enr WHERE product_id IS NOT NULL GROUP BY product_id""")

DETAIL_CTE = SNAP_CTE + """,
pd0 AS (
 SELECT product_id,
  min({'d': obs_date, 's': row_seq, 'u': units_sold, 'i': inventory_level, 'p': price, 'st': store_id}) AS r
 FROM snap WHERE product_id IS NOT NULL GROUP BY product_id),
detail AS (
 SELECT product_id, struct_extract(r, 'i') AS inventory_level, struct_extract(r, 'u') AS units_sold,
  CASE WHEN struct_extract(r, 'u') > 0
   THEN CAST(trunc(struct_extract(r, 'i') / struct_extract(r, 'u')) AS BIGINT) END AS days_left,
  struct_extract(r, 'p') AS price, struct_extract(r, 'i') * struct_extract(r, 'p') AS stock_value,
  struct_extract(r, 'st') AS store_id
 FROM pd0),
hist AS (
 SELECT product_id, CAST(count(*) AS BIGINT) AS history_rows FROM enr
 WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(*) >= 2)
"""

SQL["p10_product_detail"] = _with("SELECT * FROM detail", DETAIL_CTE)
SQL["p11_product_history"] = _with("SELECT * FROM hist", DETAIL_CTE)

SQL["p12_cover_verdict"] = _with("""
SELECT product_id, stock_units, daily_sales_units, history_rows,
 CASE WHEN daily_sales_units > 0 THEN CAST(trunc(stock_units / daily_sales_units) AS BIGINT) END
  AS days_of_stock,
 CASE WHEN stock_units IS NULL OR daily_sales_units IS NULL THEN NULL
  WHEN stock_units > daily_sales_units * 14 THEN 'plenty'
  WHEN stock_units > daily_sales_units * 7 THEN 'good' ELSE 'low' END AS verdict
FROM (SELECT d.product_id, CAST(trunc(d.inventory_level) AS BIGINT) AS stock_units,
  CAST(trunc(d.units_sold) AS BIGINT) AS daily_sales_units, h.history_rows
 FROM detail d JOIN hist h ON d.product_id = h.product_id)""", DETAIL_CTE)

# ---------------------------------------------------------------------------
# Suppliers
# ---------------------------------------------------------------------------

VENDOR_CTE = f"""
vm AS (
 SELECT vendor, avg(vendor_avg_delivery_days) AS avg_delivery_days,
  COALESCE(SUM(units_ordered), CAST(0 AS DOUBLE)) AS units_ordered,
  avg(stockout_risk) AS stockout_rate, CAST(count(DISTINCT product_id) AS BIGINT) AS product_count
 FROM enr WHERE vendor IS NOT NULL GROUP BY vendor),
vs0 AS (
 SELECT *, CAST(1 AS DOUBLE) / CASE WHEN avg_delivery_days IS NULL THEN NULL
   ELSE greatest(avg_delivery_days, CAST(0.1 AS DOUBLE)) END AS speed FROM vm),
vtop AS (SELECT max(speed) AS max_speed, max(units_ordered) AS max_ordered FROM vs0),
vs1 AS (
 SELECT vs0.vendor, avg_delivery_days, units_ordered, stockout_rate, product_count,
  COALESCE(CASE WHEN max_speed <> 0 THEN speed / max_speed END * CAST(100 AS DOUBLE), CAST(0 AS DOUBLE))
   AS delivery_score,
  COALESCE(CASE WHEN max_ordered <> 0 THEN units_ordered / max_ordered END * CAST(100 AS DOUBLE),
   CAST(0 AS DOUBLE)) AS volume_score,
  COALESCE((CAST(1 AS DOUBLE) - CASE WHEN stockout_rate IS NULL THEN NULL
    ELSE least(greatest(stockout_rate, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) END) * CAST(100 AS DOUBLE),
   CAST(0 AS DOUBLE)) AS reliability_score
 FROM vs0 CROSS JOIN vtop),
vs2 AS (
 SELECT *, round_even((delivery_score * CAST(0.4 AS DOUBLE) + volume_score * CAST(0.3 AS DOUBLE)
   + reliability_score * CAST(0.3 AS DOUBLE)) * CAST(10 AS DOUBLE), 0) / CAST(10 AS DOUBLE) AS overall_score
 FROM vs1),
vscores AS (
 SELECT *, CAST(rank() OVER (ORDER BY overall_score DESC) AS INTEGER) AS overall_rank FROM vs2)
"""

SQL["v1_vendor_metrics"] = _with("SELECT * FROM vm", VENDOR_CTE)
SQL["v5_vendor_scores"] = _with("SELECT * FROM vscores", VENDOR_CTE)

SQL["v7_vendor_summary"] = _with(f"""
SELECT CAST(count(*) AS BIGINT) AS vendor_count, {round6('avg(overall_score)')} AS avg_score,
 (SELECT vendor FROM vscores ORDER BY overall_score DESC, vendor LIMIT 1) AS best_vendor,
 max(overall_score) AS best_score,
 (SELECT vendor FROM vscores ORDER BY overall_score ASC, vendor LIMIT 1) AS worst_vendor,
 min(overall_score) AS worst_score
FROM vscores""", VENDOR_CTE)


def _band_sql(c: str) -> str:
    return (f"CASE WHEN trunc({c}) >= 70 THEN 'green' WHEN trunc({c}) >= 50 THEN 'orange' "
            f"ELSE 'red' END")


_RECS = _VENDOR_RECOMMENDATIONS
SQL["v10_vendor_cards"] = _with(f"""
SELECT vendor, overall_score, overall_rank,
 CASE WHEN overall_score >= 80 THEN 'Excellent' WHEN overall_score >= 60 THEN 'Good'
  ELSE 'Needs Improvement' END AS tier,
 CAST(trunc(delivery_score) AS BIGINT) AS delivery_points,
 CAST(trunc(volume_score) AS BIGINT) AS volume_points,
 CAST(trunc(reliability_score) AS BIGINT) AS reliability_points,
 {_band_sql('delivery_score')} AS delivery_band,
 {_band_sql('volume_score')} AS volume_band,
 {_band_sql('reliability_score')} AS reliability_band,
 CAST(CASE WHEN overall_score < 80 THEN CAST(delivery_score < 70 AS INTEGER)
   + CAST(volume_score < 70 AS INTEGER) + CAST(reliability_score < 70 AS INTEGER) ELSE 0 END AS INTEGER)
  AS recommendation_count,
 CASE WHEN overall_score < 80 THEN concat_ws('; ',
   CASE WHEN delivery_score < 70 THEN '{_RECS["delivery"]}' END,
   CASE WHEN volume_score < 70 THEN '{_RECS["volume"]}' END,
   CASE WHEN reliability_score < 70 THEN '{_RECS["reliability"]}' END) ELSE '' END AS recommendations
FROM vscores""", VENDOR_CTE)

# ---------------------------------------------------------------------------
# Procurement
# ---------------------------------------------------------------------------

ITEMS_CTE = """
items0 AS (SELECT *, round_even(inventory_level / units_sold, 0) AS days_left FROM enr WHERE units_sold > 0),
items AS (
 SELECT *, CASE WHEN days_left <= 3 THEN 'Order Today!' WHEN days_left <= 7 THEN 'Order This Week'
   WHEN days_left <= 14 THEN 'Order Soon' ELSE 'Good for Now' END AS urgency
 FROM items0),
pos0 AS (
 SELECT product_id, min({'d': obs_date, 's': row_seq, 'u': units_sold, 'i': inventory_level, 'p': price,
   'dl': days_left, 'ug': urgency}) AS r
 FROM items WHERE product_id IS NOT NULL GROUP BY product_id),
pos AS (
 SELECT product_id, struct_extract(r, 'i') AS inventory_level, struct_extract(r, 'u') AS units_sold,
  struct_extract(r, 'p') AS price, struct_extract(r, 'dl') AS days_left, struct_extract(r, 'ug') AS urgency
 FROM pos0),
speed AS (
 SELECT vendor, avg(vendor_avg_delivery_days) AS avg_delivery_days FROM items
 WHERE vendor IS NOT NULL GROUP BY vendor)
"""

SQL["l4_urgency_counts"] = _with("""
SELECT CAST(s.status_rank AS INTEGER) AS status_rank, s.urgency, CAST(count(items.urgency) AS BIGINT) AS item_count
FROM (VALUES (0, 'Order Today!'), (1, 'Order This Week'), (2, 'Order Soon'), (3, 'Good for Now'))
  AS s(status_rank, urgency)
LEFT JOIN items ON items.urgency = s.urgency
GROUP BY s.status_rank, s.urgency""", ITEMS_CTE)


def _order_list_sql(status: str, n: int) -> str:
    return f"""
SELECT CAST(row_number() OVER (ORDER BY days_left, {ORDER}) AS INTEGER) AS rank,
 product_id, inventory_level, days_left, units_sold, price,
 units_sold * CAST(30 AS DOUBLE) AS order_qty, (units_sold * CAST(30 AS DOUBLE)) * price AS order_cost
FROM items WHERE urgency = '{status}' ORDER BY rank LIMIT {n}"""


SQL["l5_order_today"] = _with(_order_list_sql("Order Today!", 5), ITEMS_CTE)
SQL["l6_order_this_week"] = _with(_order_list_sql("Order This Week", 10), ITEMS_CTE)
SQL["l7_vendor_speed"] = _with("SELECT * FROM speed", ITEMS_CTE)

SQL["l8_vendor_speed_extremes"] = _with("""
SELECT * FROM (
 SELECT 'fastest' AS speed_group,
  CAST(row_number() OVER (ORDER BY avg_delivery_days ASC NULLS LAST, vendor ASC) AS INTEGER) AS rank,
  vendor, avg_delivery_days FROM speed) WHERE rank <= 3
UNION ALL
SELECT * FROM (
 SELECT 'slowest' AS speed_group,
  CAST(row_number() OVER (ORDER BY avg_delivery_days DESC NULLS FIRST, vendor DESC) AS INTEGER) AS rank,
  vendor, avg_delivery_days FROM speed) WHERE rank <= 3""", ITEMS_CTE)

SQL["l9_order_budget"] = _with("""
SELECT CAST(t AS DOUBLE) AS today_budget, CAST(w AS DOUBLE) AS week_budget, CAST(t + w AS DOUBLE) AS total_budget
FROM (SELECT
  COALESCE(SUM(CASE WHEN urgency = 'Order Today!'
    THEN CAST((units_sold * CAST(30 AS DOUBLE)) * price AS DECIMAL(28,6)) END), 0) AS t,
  COALESCE(SUM(CASE WHEN urgency = 'Order This Week'
    THEN CAST((units_sold * CAST(30 AS DOUBLE)) * price AS DECIMAL(28,6)) END), 0) AS w
 FROM items)""", ITEMS_CTE)

SQL["l10_product_order_status"] = _with("SELECT * FROM pos", ITEMS_CTE)

SQL["l11_coverage_plan"] = _with("""
SELECT product_id, coverage_days, target_stock, order_needed, order_needed * price AS order_cost,
 CASE WHEN order_needed > 0 THEN
   CASE WHEN days_left <= 3 THEN 'Order immediately' WHEN days_left <= 7 THEN 'Order this week'
   ELSE 'Plan ahead' END
 ELSE 'No order needed' END AS advice
FROM (SELECT pos.product_id, CAST(c.coverage_days AS INTEGER) AS coverage_days, pos.days_left, pos.price,
  pos.units_sold * c.coverage_days AS target_stock,
  greatest(CAST(0 AS DOUBLE), pos.units_sold * c.coverage_days - pos.inventory_level) AS order_needed
 FROM pos CROSS JOIN (VALUES (14), (21), (30), (45), (60)) AS c(coverage_days))""", ITEMS_CTE)

# ---------------------------------------------------------------------------
# Seasonal
# ---------------------------------------------------------------------------


def _values(rows) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_SC_ROWS = [(s, c) for s, cats in _SEASONAL_CATEGORIES.items() for c in cats]
_PROFILE_ROWS = []
for _i, _s in enumerate(_SEASONS):
    _pct, _hot = _SEASON_PROFILE[_s]
    _PROFILE_ROWS.append((_s, _i, _pct, ", ".join(_hot), len(_hot), *_PLANNING_GUIDE[_s]))
_OUTLOOK_ROWS = [(c, s, t) for c, by in _CATEGORY_OUTLOOK.items() for s, t in by.items()]

SEASONAL_CTE = f"""
sc AS (SELECT * FROM (VALUES {_values(_SC_ROWS)}) AS t(season, category)),
prof AS (SELECT * FROM (VALUES {_values(_PROFILE_ROWS)}) AS t(season, season_order, demand_change_pct,
  hot_items, hot_item_count, season_label, stock_up_in, planning_hot_items, tip)),
sagg AS (
 SELECT sc.season, count(*) AS n_rows, SUM(CAST(total_value AS DECIMAL(28,6))) AS v,
  SUM(inventory_level) AS u, count_if(units_sold > 0) AS sellers,
  SUM(CASE WHEN units_sold > 0 THEN inventory_level / units_sold END) AS rs,
  count(CASE WHEN units_sold > 0 THEN inventory_level / units_sold END) AS rn
 FROM enr JOIN sc ON enr.category = sc.category GROUP BY sc.season)
"""

SQL["w2_seasonal_items"] = _with(f"""
SELECT obs_date, store_id, product_id, category, inventory_level, units_sold, price, total_value
FROM enr WHERE category IN (SELECT category FROM sc WHERE season = {CUR_SEASON})""", SEASONAL_CTE)

SQL["w3_seasonal_exposure"] = _with(f"""
SELECT p.season, CAST(p.season_order AS INTEGER) AS season_order, p.season = {CUR_SEASON} AS is_current,
 CASE p.season WHEN 'Summer' THEN 'Fall' WHEN 'Fall' THEN 'Winter' WHEN 'Winter' THEN 'Spring'
  WHEN 'Spring' THEN 'Summer' END AS next_season,
 CAST(p.demand_change_pct AS INTEGER) AS demand_change_pct, p.hot_items,
 CAST(p.hot_item_count AS INTEGER) AS hot_item_count, p.season_label, p.stock_up_in,
 p.planning_hot_items, p.tip,
 CAST(COALESCE(a.n_rows, 0) AS BIGINT) AS seasonal_rows,
 CAST(COALESCE(a.v, 0) AS DOUBLE) AS seasonal_value,
 COALESCE(a.u, CAST(0 AS DOUBLE)) AS seasonal_units,
 CAST(COALESCE(a.sellers, 0) AS BIGINT) AS seller_rows,
 {round6('a.rs / NULLIF(a.rn, 0)')} AS avg_days_left,
 CASE WHEN COALESCE(a.n_rows, 0) = 0 THEN 'none'
  WHEN COALESCE(a.sellers, 0) = 0 THEN 'no sales data'
  WHEN a.rs / NULLIF(a.rn, 0) < 14 THEN 'action needed'
  WHEN a.rs / NULLIF(a.rn, 0) < 30 THEN 'watch closely'
  ELSE 'looking good' END AS cover_status
FROM prof p LEFT JOIN sagg a ON p.season = a.season""", SEASONAL_CTE)

SQL["w5_category_outlook"] = _with(f"""
SELECT c.category, p.season, CAST(p.season_order AS INTEGER) AS season_order,
 p.season = {CUR_SEASON} AS is_current, o.category IS NOT NULL AS has_outlook,
 CAST(CASE WHEN o.txt IS NULL THEN NULL WHEN o.txt LIKE 'Normal%' THEN 0
   ELSE CAST(replace(split_part(o.txt, ' ', 1), '%', '') AS INTEGER) END AS INTEGER) AS outlook_pct,
 CASE WHEN o.txt IS NULL THEN NULL
   ELSE substr(o.txt, strpos(o.txt, '(') + 1, length(o.txt) - strpos(o.txt, '(') - 1) END AS outlook_reason,
 COALESCE(o.txt, '{_OUTLOOK_FALLBACK}') AS outlook
FROM (SELECT DISTINCT category FROM enr) c
CROSS JOIN prof p
LEFT JOIN (SELECT * FROM (VALUES {_values(_OUTLOOK_ROWS)}) AS t(category, season, txt)) o
  ON o.category = c.category AND o.season = p.season""", SEASONAL_CTE)

# ---------------------------------------------------------------------------
# Risk and order advice (F5/F6, the fitted model, have no SQL oracle)
# ---------------------------------------------------------------------------

CURRENT_CTE = """
cur0 AS (
 SELECT product_id, max({'d': obs_date, 's': row_seq, 'u': units_sold, 'c': category, 'st': store_id,
   'i': inventory_level, 'p': price, 'dd': vendor_avg_delivery_days, 'fc': demand_forecast,
   'dts': days_to_stockout}) AS r
 FROM enr WHERE product_id IS NOT NULL GROUP BY product_id),
cur AS (
 SELECT product_id, struct_extract(r, 'd') AS obs_date, struct_extract(r, 'c') AS category,
  struct_extract(r, 'st') AS store_id, struct_extract(r, 'i') AS inventory_level,
  struct_extract(r, 'u') AS units_sold, struct_extract(r, 'p') AS price,
  struct_extract(r, 'dd') AS vendor_avg_delivery_days, struct_extract(r, 'fc') AS demand_forecast,
  struct_extract(r, 'dts') AS days_to_stockout
 FROM cur0)
"""

SQL["f4_current_product_rows"] = _with("SELECT * FROM cur", CURRENT_CTE)

SQL["f7_order_recommendation"] = _with("""
SELECT product_id, recommended_qty, days_until_stockout,
 CASE WHEN recommended_qty > 0 THEN least(CAST(7 AS BIGINT), days_until_stockout) END AS order_within_days,
 CASE WHEN recommended_qty > 0 THEN CAST(trunc(vendor_avg_delivery_days) AS BIGINT) END
  AS expected_delivery_days,
 CASE WHEN days_until_stockout < 14 THEN days_until_stockout - 14 END AS reorder_delta
FROM (SELECT product_id, vendor_avg_delivery_days,
  CAST(trunc(greatest(CAST(0 AS DOUBLE), demand_forecast - inventory_level)) AS BIGINT) AS recommended_qty,
  CAST(trunc(days_to_stockout) AS BIGINT) AS days_until_stockout
 FROM cur)""", CURRENT_CTE)

SQL["f10_supply_scenarios"] = _with("""
SELECT product_id, verdict, scenario, units FROM (
 SELECT product_id, verdict, 'current_stock' AS scenario, current_stock AS units FROM sw
 UNION ALL SELECT product_id, verdict, 'one_week_supply', one_week_supply FROM sw
 UNION ALL SELECT product_id, verdict, 'two_week_supply', two_week_supply FROM sw
 UNION ALL SELECT product_id, verdict, 'one_month_supply', one_month_supply FROM sw)""",
    CURRENT_CTE + """,
sw0 AS (
 SELECT product_id, CAST(trunc(inventory_level) AS BIGINT) AS current_stock,
  CASE WHEN units_sold > 0 THEN CAST(trunc(units_sold) AS BIGINT) ELSE CAST(1 AS BIGINT) END AS daily
 FROM cur),
sw AS (
 SELECT product_id, current_stock, daily * 7 AS one_week_supply, daily * 14 AS two_week_supply,
  daily * 30 AS one_month_supply,
  CASE WHEN current_stock IS NULL THEN NULL WHEN current_stock >= daily * 30 THEN 'Excellent'
   WHEN current_stock >= daily * 14 THEN 'Good' WHEN current_stock >= daily * 7 THEN 'Watch Out'
   ELSE 'Order Now' END AS verdict
 FROM sw0)
""")

_FEATURES = ("inventory_level", "units_sold", "price", "vendor_avg_delivery_days")
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in _FEATURES)

SQL["f2_feature_scaling"] = _with(" UNION ALL ".join(f"""
SELECT '{c}' AS feature, {round6(f'avg({c})')} AS mean, {round6(f'stddev_pop({c})')} AS deviation,
 CAST(count(*) AS BIGINT) AS row_count FROM enr WHERE {_WHOLE}""" for c in _FEATURES))

SQL["f1_training_rows"] = _with(f"""
SELECT product_id, obs_date, store_id, row_seq, {', '.join(_FEATURES)}, stockout_risk FROM (
 SELECT * REPLACE (CAST(row_seq AS VARCHAR) AS row_seq, CAST(stockout_risk AS DOUBLE) AS stockout_risk), row_number() OVER (
  ORDER BY substr(md5(concat_ws('|', '42', CAST(product_id AS VARCHAR), CAST(obs_date AS VARCHAR), store_id,
   CAST(row_seq AS VARCHAR))), 1, 15), {', '.join(_FEATURES)}, stockout_risk) AS k
 FROM enr WHERE {_WHOLE} AND stockout_risk IS NOT NULL) WHERE k <= 20000""")

SQL["f5_risk_inputs"] = _with(
    f"SELECT product_id, obs_date, {', '.join(_FEATURES)}, {_WHOLE} AS scored FROM cur", CURRENT_CTE)

# ---------------------------------------------------------------------------
# Scope (P2) and missing values
# ---------------------------------------------------------------------------

SQL["p2_scoped_history"] = _with("""
SELECT product_id, CAST(count(*) AS BIGINT) AS history_rows FROM enr
WHERE category = 'Toys' AND store_id = 'EUROPE' AND product_id IS NOT NULL
GROUP BY product_id HAVING count(*) >= 2""")



def _instead(sql: str, old: str, new: str) -> str:
    """``sql`` with its one ``old`` text as ``new``; a changed base text is an error, not another query."""
    if sql.count(old) != 1:
        raise ValueError(f"{old!r} occurs {sql.count(old)} times in: {sql}")
    return sql.replace(old, new)


SQL["p2_scoped_kpis"] = _instead(SQL["p4_snapshot_kpis"], "FROM snap", "FROM snap WHERE category = 'Toys'")

SQL["p2_scoped_top_sellers"] = _instead(SQL["p6_top_sellers"], "FROM snap", "FROM snap WHERE store_id = 'EUROPE'")

SQL["s5_missing_values"] = """
SELECT CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN ' NA ' ELSE l_returnflag END AS l_returnflag,
 CAST(count(*) AS BIGINT) AS row_count, CAST(count(CASE WHEN l_quantity <> 13 THEN 1 END) AS BIGINT) AS with_quantity,
 SUM(CASE WHEN l_quantity <> 13 THEN CAST(l_quantity AS DOUBLE) END) AS quantity
FROM lineitem GROUP BY 1"""

SQL["s1_csv_ingest"] = _instead(SQL["h1_stock_health"],
    "AS total_rows\nFROM enr", """AS total_rows,
 min(obs_date) AS first_date, max(obs_date) AS last_date, CAST(count(*) AS BIGINT) AS row_numbers
FROM enr""")

SQL["s1_csv_rows"] = _with("""
SELECT obs_date, store_id, CAST(product_id AS VARCHAR) AS product_id, category, inventory_level, units_sold,
 units_ordered, demand_forecast, price, vendor || CASE product_id % 3 WHEN 0 THEN ' "The, Best" Co'
  WHEN 1 THEN ',' || chr(10) || 'of two lines' ELSE '' END AS vendor, vendor_avg_delivery_days,
 lag(inventory_level) OVER (PARTITION BY product_id ORDER BY row_seq, obs_date, units_sold) AS stock_before
FROM enr""")

SQL["s3_load_guard"] = _with("""
SELECT problem, CAST(count(*) AS BIGINT) AS row_count,
 CASE WHEN problem = 'none' THEN sum(inventory_level) END AS stock,
 CASE WHEN problem = 'none' THEN CAST(count(CASE WHEN row_seq % 109 <> 0 THEN 1 END) AS BIGINT) END AS with_delivery,
 CASE WHEN problem = 'none' THEN max(obs_date) END AS last_date
FROM (SELECT *, CASE WHEN bad = '' THEN 'none' ELSE bad END AS problem FROM (
 SELECT *, concat_ws('; ', CASE WHEN row_seq % 101 = 0 THEN 'obs_date: not a date' END,
  CASE WHEN row_seq % 103 = 0 THEN 'inventory_level: not a number' END,
  CASE WHEN row_seq % 107 = 0 THEN 'price: not a number' END) AS bad FROM enr))
GROUP BY problem""")
