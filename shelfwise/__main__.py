"""Run the reports over an inventory file: ``python -m shelfwise --input PATH``.

The dashboard's workflow without the browser: read the inventory CSV (or
Parquet), enrich and store it once, then show or write any or all reports.

  python -m shelfwise --input data/inventory.csv --report v10_vendor_cards --show 20
  python -m shelfwise --input s3://bucket/inventory/ --format parquet --out s3://bucket/reports/
"""

from __future__ import annotations

import argparse
import sys
import uuid

from shelfwise.operators import overview as H
from shelfwise.operators import products as P
from shelfwise.operators import seasonal as W
from shelfwise.operators.metrics import enrich
from shelfwise.plans.catalog import REPORTS
from shelfwise.session import build_session, scratch_path
from shelfwise.sources.inventory import load_enriched, read_inventory, save_enriched

# Reports that depend on "today" (the season); the rest ignore --as-of.
AS_OF_REPORTS = {
    "h7_category_weather_impact": lambda df, d: H.category_weather_impact(df, as_of=d),
    "h8_top_weather_impacts": lambda df, d: H.top_weather_impacts(df, as_of=d),
    "h9_weather_summary": lambda df, d: H.weather_impact_summary(df, as_of=d),
    "w2_seasonal_items": lambda df, d: W.seasonal_items(df, as_of=d),
    "w3_seasonal_exposure": lambda df, d: W.seasonal_exposure(df, as_of=d),
    "w5_category_outlook": lambda df, d: W.category_outlook(df, as_of=d),
}


# Product reports with the dashboard's category / store pickers.
SCOPED_REPORTS = {
    "p1_latest_snapshot": lambda df, c, s: P.latest_snapshot(df, c, s).select(*P.SNAPSHOT_COLUMNS),
    "p4_snapshot_kpis": P.snapshot_kpis,
    "p5_snapshot_category_stock": P.snapshot_category_stock,
    "p6_top_sellers": lambda df, c, s: P.top_sellers(df, 10, c, s),
    "p8_highest_stock": lambda df, c, s: P.highest_stock(df, 5, c, s),
    "p10_product_detail": P.product_detail,
    "p11_product_history": P.product_history_counts,
    "p12_cover_verdict": P.cover_verdict,
}


def build(name: str, df, as_of: str | None = None, category: str | None = None,
          store: str | None = None):
    if (category or store) and name in SCOPED_REPORTS:
        return SCOPED_REPORTS[name](df, category, store)
    if as_of and name in AS_OF_REPORTS:
        return AS_OF_REPORTS[name](df, as_of)
    return REPORTS[name](df)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m shelfwise", description=__doc__.split("\n")[0])
    ap.add_argument("--input", required=True, help="inventory file or folder")
    ap.add_argument("--format", default="csv", choices=("csv", "parquet"))
    ap.add_argument("--report", action="append", choices=sorted(REPORTS), metavar="NAME",
                    help="report to run (repeatable; default: all): " + ", ".join(sorted(REPORTS)))
    ap.add_argument("--as-of", help="date deciding the current season (default 2025-08-07)")
    ap.add_argument("--category", help="product reports: only this category")
    ap.add_argument("--store", help="product reports: only this store")
    ap.add_argument("--show", type=int, default=20, help="rows to print per report")
    ap.add_argument("--out", help="write each report as Parquet under this folder instead")
    ap.add_argument("--date-format", help="Spark date pattern (default: ISO or month/day/year)")
    ap.add_argument("--lenient", action="store_true", help="bad numbers/dates become NULL")
    args = ap.parse_args(argv)

    spark = build_session()
    inv = enrich(read_inventory(spark, args.input, fmt=args.format, strict=not args.lenient,
                                date_format=args.date_format))
    names = args.report or [n for n in REPORTS if n != "m_enrich"]
    if len(names) > 1:  # read, parse and enrich once; each report then reads what it needs
        store = scratch_path(spark, f"enriched-{uuid.uuid4().hex}")
        save_enriched(inv, store, files=0)
        inv = load_enriched(spark, store)
    for name in names:
        df = build(name, inv, args.as_of, args.category, args.store)
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
        else:
            print(f"== {name}")
            df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
