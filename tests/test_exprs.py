"""Expression helpers: packed order number, half-even rounding, strict maximum."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from shelfwise.functions.exprs import (order_number, order_number_date, order_number_seq,
                                       round_half_even, strict_greatest)


def test_order_number_orders_like_the_pair_and_decodes(spark):
    rnd = random.Random(3)
    dates = [dt.date(1, 1, 1), dt.date(1970, 1, 1), dt.date(2001, 11, 4), dt.date(9999, 12, 31)]
    seqs = [-(10 ** 28), -1, 0, 1, 2 ** 63 - 1, 4 * 10 ** 21, 10 ** 28]
    rows = []
    for _ in range(160):
        d = rnd.choice(dates)
        if d.year < 9999:
            d += dt.timedelta(days=rnd.randint(0, 3))
        rows.append((d, Decimal(rnd.choice(seqs) + rnd.randint(0, 5))))
    df = spark.createDataFrame(rows, "obs_date date, row_seq decimal(38,0)")
    out = df.select("obs_date", "row_seq", order_number().alias("n")).collect()
    by_pair = sorted(out, key=lambda r: (r.obs_date, r.row_seq))
    by_number = sorted(out, key=lambda r: r.n)
    assert [(r.obs_date, r.row_seq) for r in by_pair] == [(r.obs_date, r.row_seq) for r in by_number]
    back = df.select("obs_date", "row_seq", order_number().alias("n")).select(
        "obs_date", "row_seq", order_number_date("n").alias("d"), order_number_seq("n").alias("s"))
    for r in back.collect():
        assert (r.d, r.s) == (r.obs_date, r.row_seq)


def test_round_half_even_and_strict_greatest(spark):
    df = spark.createDataFrame([(14.5, None), (15.5, 2.0), (61.25, 3.0), (-2.5, -1.0)],
                               "x double, y double")
    got = df.select(round_half_even("x").alias("r0"), round_half_even("x", 1).alias("r1"),
                    strict_greatest(F.lit(0.0), "y").alias("g")).collect()
    assert [r.r0 for r in got] == [14.0, 16.0, 61.0, -2.0]
    assert [r.r1 for r in got] == [14.5, 15.5, 61.2, -2.5]
    assert [r.g for r in got] == [None, 2.0, 3.0, 0.0]
