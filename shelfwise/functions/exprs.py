"""Column expressions with the missing-value and rounding rules of the reports.

All of these are built-in Spark expressions, so they compile into the
surrounding whole-stage-codegen span; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.schema import OBS_DATE, ORDER_COLS, ROW_SEQ

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_greatest(*cols: ColumnOrName) -> Column:
    """``greatest`` that is NULL when any input is NULL.

    Spark's ``greatest`` skips NULLs; the element-wise maximum of the
    reports propagates a missing value instead.
    """
    cs = [col(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, F.greatest(*cs))


def null_safe_clip(c: ColumnOrName, lower: float | None = None,
                   upper: float | None = None) -> Column:
    """Clip to [lower, upper] but keep NULL as NULL."""
    c = col(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)


def round_half_even(c: ColumnOrName, places: int = 0) -> Column:
    """Round half to even the way NumPy does: ``rint(x * 10^p) / 10^p``.

    ``F.round`` rounds half up (14.5 -> 15); the reports round 14.5 -> 14.
    """
    c = col(c)
    if places == 0:
        return F.rint(c)
    scale = float(10 ** places)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def trunc_to_long(c: ColumnOrName) -> Column:
    """Python ``int(x)``: truncate toward zero; NULL (or NaN) stays NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c.cast("bigint"))


# Money is summed as a decimal, whose partial sums merge exactly: doubles summed
# in another order differ in the last bits.  Six places keep an amount unrounded.
MONEY = "decimal(28,6)"


def money_sum(c: ColumnOrName) -> Column:
    """Exact sum of amounts, returned as a double."""
    return F.sum(col(c).cast(MONEY)).cast("double")


def season_of_month(month: ColumnOrName) -> Column:
    """Month number -> season name; NULL for a missing month."""
    m = col(month)
    return (F.when(m.isin(12, 1, 2), F.lit("Winter"))
            .when(m.isin(3, 4, 5), F.lit("Spring"))
            .when(m.isin(6, 7, 8), F.lit("Summer"))
            .when(m.isin(9, 10, 11), F.lit("Fall")))


def next_season(season: ColumnOrName) -> Column:
    s = col(season)
    return (F.when(s == "Summer", F.lit("Fall"))
            .when(s == "Fall", F.lit("Winter"))
            .when(s == "Winter", F.lit("Spring"))
            .when(s == "Spring", F.lit("Summer")))


def ladder(value: ColumnOrName, steps: Sequence[tuple[float, str]],
           otherwise: str | None = None, op: str = "<=") -> Column:
    """A threshold ladder: first step whose ``value op threshold`` holds.

    A NULL value fails every comparison and falls to ``otherwise``.
    """
    v = col(value)
    compare = {"<=": lambda t: v <= t, "<": lambda t: v < t,
               ">=": lambda t: v >= t, ">": lambda t: v > t}[op]
    out = None
    for threshold, label in steps:
        cond = compare(F.lit(threshold))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if otherwise is not None:
        out = out.otherwise(F.lit(otherwise))
    return out


def order_struct(order_cols: Sequence[str] = ORDER_COLS) -> Column:
    """A struct that orders like ``order_keys``: ascending, a missing value last."""
    return F.struct(*[x for i, c in enumerate(order_cols)
                      for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))])


def with_order_cols(*cols: str, order_cols: Sequence[str] = ORDER_COLS) -> list[str]:
    """``cols`` followed by the file-order columns not already among them."""
    return list(cols) + [c for c in order_cols if c not in cols]


def order_keys(order_cols: Sequence[str] = ORDER_COLS, descending: bool = False) -> list[Column]:
    if descending:
        return [F.col(c).desc_nulls_last() for c in order_cols]
    return [F.col(c).asc_nulls_last() for c in order_cols]


# Packing of (date, row sequence) into one DECIMAL(38,0) that orders like the
# pair: (days since 0001-01-01) * 10^30 + (row_seq + 10^29).  Valid for any
# DATE and any |row_seq| < 10^29; a missing date or sequence sorts last, as a day
# or a sequence beyond all others.  The largest value is below 10^37.
_DAY_OFFSET = 719162  # days from 0001-01-01 to 1970-01-01
_NO_DAY = 9_000_000
_NO_SEQ = "CAST('8" + "0" * 29 + "' AS DECIMAL(38,0))"
_SEQ_SCALE = "CAST('1" + "0" * 30 + "' AS DECIMAL(38,0))"
_SEQ_OFFSET = "CAST('1" + "0" * 29 + "' AS DECIMAL(38,0))"


def order_number(date_col: str = OBS_DATE, seq_col: str = ROW_SEQ) -> Column:
    """The (date, row sequence) position of a row as one orderable number.

    ``min``/``max`` of it plan as a hash aggregation (a fixed-width decimal
    buffer), where the same over a struct needs a sort-based aggregation.
    Use it where only the position is needed, not other fields of the row.
    """
    days = F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date")) + F.lit(_DAY_OFFSET)
    days = F.coalesce(days, F.lit(_NO_DAY))
    seq = F.coalesce(F.col(seq_col).cast("decimal(38,0)"), F.expr(_NO_SEQ))
    return (days.cast("decimal(38,0)") * F.expr(_SEQ_SCALE) + (seq + F.expr(_SEQ_OFFSET))).cast("decimal(38,0)")


def order_number_date(number: ColumnOrName) -> Column:
    """The date packed in an :func:`order_number`."""
    n = col(number)
    days = F.floor(n / F.expr(_SEQ_SCALE)).cast("int")
    return F.when(days != _NO_DAY, F.date_add(F.lit("1970-01-01").cast("date"), days - F.lit(_DAY_OFFSET)))


def order_number_seq(number: ColumnOrName) -> Column:
    """The row sequence packed in an :func:`order_number` (as DECIMAL(38,0))."""
    n = col(number)
    seq = (n % F.expr(_SEQ_SCALE) - F.expr(_SEQ_OFFSET)).cast("decimal(38,0)")
    return F.when(seq != F.expr(_NO_SEQ), seq)
