"""Helpers shared by the report operators."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.exprs import order_number, order_struct, season_of_month
from shelfwise.schema import ORDER_COLS

# The dashboard's fixed "today" for seasonal pages; reports take it as an
# argument so that results are repeatable.
DEFAULT_AS_OF = "2025-08-07"


def as_of_season(as_of: str | _dt.date = DEFAULT_AS_OF) -> Column:
    """Season of the ``as_of`` date as a constant-folded expression."""
    return season_of_month(F.month(F.lit(str(as_of)).cast("date")))


def top_n(df: DataFrame, keys: Sequence[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows by ``keys`` with their 1-based position.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: every partition
    keeps its own top ``n`` and only ``n x partitions`` rows reach the final
    merge.  The position is numbered over those ``n`` rows only.
    """
    head = df.orderBy(*keys).limit(n)
    return head.withColumn(rank_col, F.row_number().over(Window.orderBy(*keys)))


def bounded_rank(df: DataFrame, score: str, rank_col: str, descending: bool = True) -> DataFrame:
    """SQL ``RANK()`` over a score with few distinct values, without a global window.

    An unpartitioned window pulls every row into one task.  Instead the
    distinct scores are counted (partial aggregation), the running count over
    the *distinct scores* gives each score its rank, and that small table is
    joined back.  For scores of a small domain (e.g. a 0-100 score rounded to
    one place: at most 1001 values).  The join's strategy is left to Spark, which
    broadcasts the table of scores after checking its size.
    """
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(
        F.col(score),
        (F.coalesce(F.sum("_n").over(w), F.lit(0)) + F.lit(1)).cast("int").alias(rank_col))
    return df.join(ranks, on=score, how="left")


def ranked(df: DataFrame, keys: Sequence[Column], rank_col: str) -> DataFrame:
    """Adds the 1-based position of every row by ``keys``, which no two rows should share.

    A window without partitions would bring all rows into one task.  Here a
    sort by range gives each partition its place, rows are numbered where
    they lie, and a row's position is its own number and the rows of the partitions
    before.  Only those counts, a row for each partition, meet in a window.
    The sorted rows are persisted: numbers and counts must come from one sort.
    """
    at, part, place = "_at", F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = shared(df.orderBy(*keys).withColumn(at, F.monotonically_increasing_id()))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(before, "_part") \
        .select(*df.columns, (F.col("_before") + place + F.lit(1)).cast("bigint").alias(rank_col))


def order_position(order_cols: Sequence[str] = ORDER_COLS) -> Column:
    """The file-order position as one value: packed for the default columns, else a struct."""
    return order_number(*ORDER_COLS) if tuple(order_cols) == ORDER_COLS else order_struct(order_cols)


def end_rows(df: DataFrame, by: str, numbers: Sequence[str], texts: Sequence[str] = (),
             which: str = "first", order_cols: Sequence[str] = ORDER_COLS) -> DataFrame:
    """The first or last row, in file order, of every ``by`` group.

    Fixed-width columns are picked by ``min_by``/``max_by`` on the packed
    position, a hash aggregation that is partial per map task.  Text columns
    need a sort-based aggregation, so they first join the grouping key: the
    fact rows are hashed, and only one row per (group, texts) is sorted.
    """
    if which not in ("first", "last"):
        raise ValueError(f"which must be 'first' or 'last', not {which!r}")
    end, pick = (F.min, F.min_by) if which == "first" else (F.max, F.max_by)
    at = order_position(order_cols)
    rows = df.where(F.col(by).isNotNull()).groupBy(by, *texts).agg(
        end(at).alias("_at"), *[pick(c, at).alias(c) for c in numbers])
    if texts:
        rows = rows.groupBy(by).agg(*[pick(c, "_at").alias(c) for c in (*numbers, *texts)])
    return rows.select(by, *numbers, *texts)


_SHARED: list[DataFrame] = []
_KEPT_SHARED = 8


def shared(df: DataFrame) -> DataFrame:
    """Mark a small aggregate that several branches of one report consume.

    Column pruning gives each consumer its own narrower variant of the
    aggregate, so Spark cannot reuse the shuffle and would scan the fact
    table once per branch.  Persisting (lazily, at the first action;
    memory then disk; lost blocks recompute from lineage) makes all branches
    read one computation.  Use only on aggregates whose row count is that of
    a dimension (vendors, categories), never on fact rows.  The last few are
    kept; an older one is released, and a report that still reads it computes
    it again.
    """
    # tables of a session that has ended are gone with it
    _SHARED[:] = [d for d in _SHARED if d.sparkSession is df.sparkSession]
    _SHARED.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    while len(_SHARED) > _KEPT_SHARED:
        old = _SHARED.pop(0)
        if not any(old.sameSemantics(d) for d in _SHARED):
            old.unpersist()
    return df
