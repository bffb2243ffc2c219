"""Run a catalog query in Spark and its SQL oracle in DuckDB, and compare.

Columns are compared by name (sorted) and type, rows as an unordered
multiset, values exactly (floats by bit-for-bit equality after normalising
-0.0 and NaN).
Usage: ``python -m shelfwise.plans.verify SF_DIR [name ...]``.
"""

from __future__ import annotations

import datetime as _dt
import math
import sys
import time
from decimal import Decimal

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duckdb_connection(sf_dir: str):
    import duckdb
    import os
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        if v == 0.0:
            v = 0.0
        return (2, repr(v))
    if isinstance(v, bool):
        return (3, str(v))
    if isinstance(v, (int, Decimal)):
        return (2, repr(float(v)) if isinstance(v, Decimal) else str(v))
    if isinstance(v, _dt.datetime):
        return (4, v.isoformat())
    if isinstance(v, _dt.date):
        return (4, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (5, repr([_norm(x) for x in v]))
    return (6, str(v))


def _rows(records, cols):
    return sorted(tuple(_norm(r[c]) for c in cols) for r in records)


# Spark type name -> DuckDB type name, for the types the reports produce.
TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
            "date": "DATE", "boolean": "BOOLEAN"}


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from shelfwise.plans.catalog import QUERIES
    from shelfwise.plans.oracle import SQL
    con = con or duckdb_connection(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(SQL[name])
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    dcols = list(rel.columns)
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    t2 = time.time()
    scols = sorted(sdf.columns)
    out = {"name": name, "spark_rows": len(srows), "oracle_rows": len(drows),
           "spark_sec": round(t1 - t0, 2), "oracle_sec": round(t2 - t1, 2)}
    if scols != sorted(dcols):
        out.update(ok=False, reason=f"columns differ: spark={scols} oracle={sorted(dcols)}")
        return out
    stypes = dict(sdf.dtypes)
    bad_types = [(c, stypes[c], dtypes[c]) for c in scols
                 if TYPE_MAP.get(stypes[c], stypes[c]) != dtypes[c]]
    if bad_types:
        out.update(ok=False, reason=f"types differ: {bad_types}")
        return out
    a, b = _rows(srows, scols), _rows(drows, scols)
    if len(a) != len(b):
        out.update(ok=False, reason="row counts differ")
        return out
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diffs = [(c, x[i], y[i]) for i, c in enumerate(scols) if x[i] != y[i]]
        out.update(ok=False, reason=f"{len(bad)} rows differ; first: {diffs[:4]}")
        return out
    out["ok"] = True
    return out


def main(argv: list[str]) -> int:
    from shelfwise.plans.catalog import QUERIES
    from shelfwise.plans.oracle import SQL
    from shelfwise.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or [n for n in QUERIES if n in SQL]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    con = duckdb_connection(sf_dir)
    failed = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and keep going
            r = {"name": n, "ok": False, "reason": f"{type(e).__name__}: {str(e)[:400]}"}
        failed += not r["ok"]
        print(r, flush=True)
    print(f"{len(names) - failed}/{len(names)} match")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
