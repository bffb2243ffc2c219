"""One date format per column, elected from the data.

A dashboard's file has one way to write dates.  ``elect`` counts, in one pass over
the distinct texts, the values that each candidate format parses; the format that
parses every value wins.  If several do and don't agree on the dates (day and month
up to 12 in every value), the file is ambiguous and the caller has to say which it
is; if none does, the error states how far the best one got.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = "iso"
_TIME = "[['T'][' ']H:mm[:ss[.SSSSSS]]]"
#: Candidates: ISO text and Spark patterns, each with an optional time of day.
FORMATS: tuple[str, ...] = (ISO, *[d + _TIME for d in (
    "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy")])


class DateFormatError(ValueError):
    """No format, or more than one, fits a column of dates."""


def parsed(text: Column, date_format: str) -> Column:
    """The date that a text has in a format, NULL if it has none."""
    if date_format == ISO:
        return text.try_cast("date")
    return F.try_to_timestamp(text, F.lit(date_format)).cast("date")


def elect(texts: DataFrame, column: str, formats: Sequence[str] = FORMATS, strict: bool = True) -> str:
    """The format that fits every text of the column; NULLs don't count.

    Without ``strict`` the format that fits most, the first of equal ones.  The texts
    are grouped first: a column of dates has as many distinct texts as days.
    """
    values = texts.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_text")).agg(F.count("*").alias("_n"))
    fits = {f: parsed(F.col("_text"), f) for f in formats}
    hit = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))
    one = values.agg(hit(F.lit(True)).alias("total"), *[hit(fits[f].isNotNull()).alias(f"f{i}")
                                                        for i, f in enumerate(formats)]).first()
    total, found = one["total"], {f: one[f"f{i}"] for i, f in enumerate(formats)}
    best = max(formats, key=lambda f: found[f])  # the first of equal ones
    if not strict:
        return best
    whole = [f for f in formats if found[f] == total]
    if not whole:
        sample = values.where(parsed(F.col("_text"), best).isNull()).agg(F.min("_text")).first()[0]
        raise DateFormatError(
            f"column {column}: no date format fits all {total} values; {best!r} fits {found[best]} and not "
            f"the other {total - found[best]}, such as {sample!r}")
    if len(whole) > 1 and total:
        differ = F.size(F.array_distinct(F.array(*[fits[f] for f in whole]))) > 1
        odd = values.agg(hit(differ).alias("n"), F.min(F.when(differ, F.col("_text"))).alias("text")).first()
        if odd["n"]:
            raise DateFormatError(f"column {column}: {whole} fit every value and differ on {odd['n']} of them, such as "
                                  f"{odd['text']!r}; name the one that is meant as date_format")
    return whole[0]
