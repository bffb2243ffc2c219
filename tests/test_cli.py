"""The command-line runner over a dashboard-style CSV."""

import os
import tempfile

from shelfwise.__main__ import main

HEADER = ("Date,Store ID,Product ID,Category,Inventory Level,Units Sold,Units Ordered,"
          "Demand Forecast,Price,Vendor,Vendor Avg Delivery Days\n")
ROWS = ["2025-01-0{d},S00{s},P000{p},{c},{inv},{sold},20,{fc},9.99,Vendor {v},{dd}".format(
    d=1 + i % 5, s=1 + i % 2, p=i % 4, c=["Toys", "Clothing", "Groceries"][i % 3],
    inv=10 * i % 170, sold=i % 9, fc=(i * 7) % 120, v="AB"[i % 2], dd=2 + i % 6) for i in range(40)]


def test_cli_writes_every_report(spark):
    d = tempfile.mkdtemp(prefix="shelfwise-cli-")
    path = os.path.join(d, "inventory.csv")
    with open(path, "w") as fh:
        fh.write(HEADER + "\n".join(ROWS) + "\n")
    out = os.path.join(d, "reports")
    reports = ["h1_stock_health", "v10_vendor_cards", "w3_seasonal_exposure", "l11_coverage_plan"]
    args = ["--input", path, "--out", out, "--as-of", "2025-01-15"]
    for r in reports:
        args += ["--report", r]
    assert main(args) == 0
    for r in reports:
        assert spark.read.parquet(os.path.join(out, r)).count() > 0
    seasons = spark.read.parquet(os.path.join(out, "w3_seasonal_exposure"))
    assert [r.season for r in seasons.where("is_current").collect()] == ["Winter"]


def test_cli_scope_filters(spark):
    d = tempfile.mkdtemp(prefix="shelfwise-cli-")
    path = os.path.join(d, "inventory.csv")
    with open(path, "w") as fh:
        fh.write(HEADER + "\n".join(ROWS) + "\n")
    out = os.path.join(d, "reports")
    assert main(["--input", path, "--out", out, "--report", "p1_latest_snapshot",
                 "--category", "Toys", "--store", "S001"]) == 0
    rows = spark.read.parquet(os.path.join(out, "p1_latest_snapshot")).collect()
    assert rows and all(r.category == "Toys" and r.store_id == "S001" for r in rows)
