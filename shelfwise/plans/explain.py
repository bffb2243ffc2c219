"""Summarise the physical plan of every report over a stored enriched table.

Usage: ``python -m shelfwise.plans.explain SF_DIR [name ...]``.  The static
physical plan of each report (adaptive execution off in this tool's session,
so every node is listed once) is reduced to counts of Parquet scans, cache
reads, shuffles, broadcasts, join and aggregate kinds, windows and top-N.
At runtime AQE may still turn a sort-merge join into a broadcast join and
coalesce shuffle partitions.
"""

from __future__ import annotations

import re
import sys
import uuid

# Node names as they head the numbered sections of ``explain("formatted")``;
# every physical node appears there exactly once (a cached relation's own
# plan is printed only inside its arguments, so it is not double counted).
NODES = {
    "scans": ("Scan parquet",),
    "cache_reads": ("InMemoryTableScan",),
    "shuffles": ("Exchange",),
    "broadcasts": ("BroadcastExchange",),
    "broadcast_joins": ("BroadcastHashJoin", "BroadcastNestedLoopJoin"),
    "merge_joins": ("SortMergeJoin",),
    "hash_agg": ("HashAggregate",),
    "sort_agg": ("SortAggregate",),
    "windows": ("Window",),
    "top_n": ("TakeOrderedAndProject",),
}
PATTERNS = NODES


def _formatted(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarise(df) -> dict[str, int]:
    text = _formatted(df)
    names = re.findall(r"^\(\d+\) ([A-Za-z]+(?: parquet)?)", text, flags=re.M)
    return {k: sum(1 for n in names if n in v) for k, v in NODES.items()}


def main(argv: list[str]) -> int:
    from shelfwise.plans.catalog import MODEL_REPORTS, REPORTS, enriched
    from shelfwise.session import build_session, scratch_path
    from shelfwise.sources.inventory import load_enriched, save_enriched
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or [n for n in REPORTS if n not in MODEL_REPORTS]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    store = scratch_path(spark, f"explain-{uuid.uuid4().hex[:12]}")
    save_enriched(enriched(spark, sf_dir), store, files=8)
    table = load_enriched(spark, store)
    table.count()
    print("| report | " + " | ".join(PATTERNS) + " |")
    print("|---" * (len(PATTERNS) + 1) + "|")
    for n in names:
        s = summarise(REPORTS[n](table))
        print(f"| {n} | " + " | ".join(str(s[k]) for k in PATTERNS) + " |", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
