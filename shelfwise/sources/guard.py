"""S3: a load that puts bad rows aside with the reason, and counts them as it goes.

``read_inventory`` fails on the first bad value.  ``guarded_inventory`` reads every
record, writes the sound ones typed and the others with their texts and what is wrong
with each, and counts both while it writes: one pass over the file does all three.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfwise import schema as S
from shelfwise.sources import dates
from shelfwise.sources.inventory import NA_TEXTS, csv_reader, in_file_order

PROBLEMS, RECORD, ACCEPTED = "problems", "record", "accepted"
STRUCTURE = "wrong number of fields"
_LINE = "_line"


def problem_of(column: str) -> str:
    """What is reported of a value that its column can't hold."""
    return f"{column}: not a {'date' if column == S.OBS_DATE else 'number'}"


#: every problem that a row can have, as reported
KNOWN = (STRUCTURE, *[problem_of(c) for c in (S.OBS_DATE, *S.MEASURES)])


class Guarded(NamedTuple):
    accepted: DataFrame  #: the inventory table of the sound rows
    rejected: DataFrame  #: row_seq, problems (array), record (the row's texts as JSON)
    counts: dict[str, int]  #: rows, accepted, and each problem that occurs

    def check(self, most: float = 0.0) -> Guarded:
        """This, if at most that share of the rows is rejected, else an error that says why."""
        bad = self.counts["rows"] - self.counts[ACCEPTED]
        if bad > most * self.counts["rows"]:
            raise S.InventorySchemaError(f"{bad} of {self.counts['rows']} rows are bad: " + ", ".join(
                f"{k} ({v})" for k, v in self.counts.items() if k not in ("rows", ACCEPTED)))
        return self


def _texts(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """The records of a CSV path as texts; ``_line`` holds a record of too few or too many fields."""
    header = csv_reader(spark, multiline).csv(path).columns
    schema = ", ".join(f"`{c}` STRING" for c in [*header, _LINE])
    # every field is read, so that a record's number of fields is seen
    raw = csv_reader(spark, multiline).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE) \
        .option("columnPruning", False).schema(schema).csv(path)
    return in_file_order(raw, sorted(raw.inputFiles()))


def guarded_inventory(spark: SparkSession, path: str, out: str, multiline: bool = False,
                      date_format: str | None = None) -> Guarded:
    """Load a CSV file or folder into ``out``: sound rows typed, bad rows with their problems.

    A row is bad if it has too few or too many fields, or a date or number that can't be
    read; missing values are sound.  Without ``date_format`` the format that most dates
    have is taken.  The columns themselves must be there.
    """
    raw = _texts(spark, path, multiline)
    texts = raw.withColumnsRenamed({k: v for k, v in S.CSV_HEADERS.items() if k in raw.columns})
    lacking = [c for c in S.CSV_HEADERS.values() if c not in texts.columns]
    if lacking:
        raise S.InventorySchemaError(f"inventory table lacks columns: {lacking}")
    known = {c: F.when(~F.col(c).isin(*NA_TEXTS), F.col(c)) for c in S.CSV_HEADERS.values()}
    if not date_format:
        date_format = dates.elect(texts.select(known[S.OBS_DATE].alias("d")), "d", strict=False)
    typed = {c: dates.parsed(known[c], date_format) if c == S.OBS_DATE else
             known[c].try_cast("double") if c in S.MEASURES else known[c] for c in S.CSV_HEADERS.values()}
    # a number that is no number, such as "NaN" in another spelling, is a missing one
    typed |= {c: F.nanvl(typed[c], F.lit(None).cast("double")) for c in S.MEASURES}
    broken = F.col(_LINE).isNotNull()

    def wrong(c: str) -> Column:
        value = dates.parsed(known[c], date_format) if c == S.OBS_DATE else known[c].try_cast("double")
        return F.when(~broken & known[c].isNotNull() & value.isNull(), F.lit(problem_of(c)))

    problems = F.array_compact(F.array(F.when(broken, F.lit(STRUCTURE)), *[wrong(c) for c in (S.OBS_DATE, *S.MEASURES)]))
    given = [c for c in raw.columns if c not in (S.ROW_SEQ, _LINE)]
    record = F.coalesce(F.to_json(F.struct(F.col(_LINE).alias("line"))), F.lit("{}"))
    fields = F.to_json(F.struct(*[F.col(S.CSV_HEADERS.get(c, c)).alias(c) for c in given]))
    rows = texts.withColumn(PROBLEMS, problems).select(
        *[typed[c].alias(c) for c in typed], S.ROW_SEQ, PROBLEMS,
        F.when(F.size(PROBLEMS) > 0, F.when(broken, record).otherwise(fields)).alias(RECORD),
        (F.size(PROBLEMS) == 0).alias(ACCEPTED))
    seen = Observation("inventory guard")
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(ACCEPTED).alias(ACCEPTED),
                 *[F.count_if(F.array_contains(PROBLEMS, p)).alias(p) for p in KNOWN]) \
        .write.mode("overwrite").partitionBy(ACCEPTED).parquet(out)
    counts = {k: v for k, v in seen.get.items() if v or k in ("rows", ACCEPTED)}
    # the reader gets the schema, as a load may have no rows of one kind
    back = spark.read.schema(rows.schema).parquet(out)
    sound = back.where(ACCEPTED).select(*S.REQUIRED)
    return Guarded(S.validate_schema(sound), back.where(~F.col(ACCEPTED)).select(S.ROW_SEQ, PROBLEMS, RECORD), counts)


def problem_counts(guarded: Guarded, extra: Sequence[Column] = ()) -> DataFrame:
    """Rows per combination of problems, the sound ones as ``none``."""
    kind = lambda df, c: df.withColumn("problem", c)
    bad = kind(guarded.rejected, F.array_join(PROBLEMS, "; ")).select("problem")
    good = kind(guarded.accepted, F.lit("none")).select("problem")
    return bad.unionByName(good).groupBy("problem").agg(F.count("*").alias("row_count"), *extra)
