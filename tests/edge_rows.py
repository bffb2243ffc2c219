"""The hand-checked edge rows of FIXTURES.md section 3."""

import datetime as dt


from shelfwise.schema import INVENTORY_SCHEMA

# k, inv, sold, forecast, lead, days, status, risk, rop, lt_risk, target, suggested,
# days_left, urgency ("dropped" = not a selling row)
EDGE = [
    (1, 100, 0, 5, 4, 100, "Good", 0, 0, 0, 0, 0, None, "dropped"),
    (2, 70, 10, 80, 2, 7, "Critical", 1, 50, 0, 350, 280, 7, "Order This Week"),
    (3, 71, 10, 71, 2, 8, "Warning", 0, 50, 0, 350, 140, 7, "Order This Week"),
    (4, 140, 10, 10, 2, 14, "Warning", 0, 50, 0, 350, 140, 14, "Order Soon"),
    (5, 145, 10, 10, 8, 15, "Good", 0, 200, 1, 500, 140, 14, "Order Soon"),
    (6, 35, 10, 40, 8, 4, "Critical", 1, 200, 1, 500, 465, 4, "Order This Week"),
    (7, 25, 10, 20, 2, 3, "Critical", 0, 50, 1, 350, 325, 2, "Order Today!"),
    (8, None, 10, 80, 2, None, None, 0, 50, 0, 350, None, None, "Good for Now"),
    (9, 5, None, 10, 2, 5, "Critical", 1, None, 0, None, None, None, "dropped"),
    (10, 0, 10, 0, 1, 0, "Critical", 0, 25, 1, 325, 325, 0, "Order Today!"),
    (11, 50, 10, None, None, 5, "Critical", 0, None, 0, None, None, 5, "Order This Week"),
    (12, -5, 0, 0, 2, -5, "Critical", 1, 0, 1, 0, 5, None, "dropped"),
]


def f(x):
    return None if x is None else float(x)


def edge_frame(spark, date=dt.date(2025, 1, 15), category="Electronics", vendor="V1"):
    rows = [(date, "S1", str(k), category, f(inv), f(sold), 5.0, f(fc), 10.0, vendor, f(lead), k)
            for (k, inv, sold, fc, lead, *_rest) in EDGE]
    return spark.createDataFrame(rows, INVENTORY_SCHEMA)
