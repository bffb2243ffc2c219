"""Reading, normalising and storing the inventory table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise import schema as S
from shelfwise.sources import dates

# Text that pandas' CSV reader takes as a missing value by
# default.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
            "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
            "nan", "null")

#: rows of a file of the stored table, or of a CSV that can't be split
ROWS_PER_FILE = 250_000


def normalise_missing(df: DataFrame, text: bool = False) -> DataFrame:
    """NaN -> NULL on doubles and, with ``text`` (CSV), missing-value text -> NULL.

    Spark (and SQL) order NaN above every number, while a NaN comparison is
    false in the dashboard; turning NaN into NULL at ingest makes every later
    comparison and aggregate skip it the same way.  Text is compared as it
    stands, blanks included, and only where it comes from CSV: a typed table
    says itself what is missing, so a vendor named ``NA`` stays there.
    """
    exprs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        t = f.dataType.typeName()
        if t == "string" and text:
            c = F.when(~c.isin(*NA_TEXTS), c)
        elif t in ("double", "float"):
            c = F.nanvl(c, F.lit(None).cast(t))
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def _rename_headers(df: DataFrame) -> DataFrame:
    mapping = {k: v for k, v in S.CSV_HEADERS.items() if k in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df


def _date(c: str, date_format: str, strict: bool):
    """A date from text in one format."""
    found = dates.parsed(F.col(c), date_format)
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a date: "), F.col(c))).cast("date")
        found = F.when(F.col(c).isNotNull() & found.isNull(), bad).otherwise(found)
    return found


def _typed(df: DataFrame, strict: bool, date_format: str) -> DataFrame:
    """Cast text columns to the inventory types; other columns are dropped.

    A row number made at the read is no text and stays as it is.

    ``strict``: one malformed number or date fails the whole load (S2/S3).
    Otherwise it becomes NULL.
    """
    def cast(c: str, t: str):
        return F.col(c).cast(t) if strict else F.expr(f"try_cast(`{c}` AS {t})")

    exprs = []
    for f in S.INVENTORY_SCHEMA.fields:
        if f.name not in df.columns:
            continue
        if f.name == S.OBS_DATE:
            exprs.append(_date(f.name, date_format, strict).alias(f.name))
        elif f.name in S.MEASURES:
            exprs.append(cast(f.name, "double").alias(f.name))
        elif f.name == S.ROW_SEQ:
            made = df.schema[f.name].dataType.typeName() != "string"
            exprs.append(F.col(f.name) if made else cast(f.name, "bigint").alias(f.name))
        else:
            exprs.append(F.col(f.name).cast("string").alias(f.name))
    return df.select(*exprs)


# Places of (file number, offset of the split in the file, row in the task) in row_seq:
# tasks of up to 10^10 rows, files of up to 10^12 bytes, 10^7 files.
_FILE_PLACE, _SPLIT_PLACE = 10 ** 22, 10 ** 10


def _numbered(rows: DataFrame, files: Sequence[str], number_from: int, place: Column) -> DataFrame:
    """Adds ``row_seq``: files in the order given, then ``place``; ``_file`` names a row's file."""
    scale = F.expr(f"CAST('{_FILE_PLACE}' AS DECIMAL(38,0))")
    if len(files) == 1:
        return rows.withColumn(S.ROW_SEQ, (F.lit(number_from).cast("decimal(38,0)") * scale + place)
                               .cast("decimal(38,0)"))
    # the listing is on the driver already; unless it is broadcast, all rows are dealt by their file
    # and each task sorts files as a whole
    numbers = F.broadcast(rows.sparkSession.createDataFrame(pa.table({
        "_number": pa.array(range(number_from, number_from + len(files)), pa.int64()),
        "_file": pa.array(files, pa.string())})))
    known = F.coalesce("_number", F.raise_error(F.concat(F.lit("not in the listing: "), F.col("_file"))).cast("long"))
    seq = (known.cast("decimal(38,0)") * scale + place).cast("decimal(38,0)")
    return rows.join(numbers, "_file", "left").withColumn(S.ROW_SEQ, seq)


def in_file_order(df: DataFrame, files: Sequence[str], number_from: int = 0) -> DataFrame:
    """Adds ``row_seq`` to the rows of text files: files in the order given, then the order in each.

    A task may read its splits in any order, but it reads each from start to
    end, so the split's offset in its file and the running number of the row
    place a row.  The number of a file comes from a join with the listing.
    """
    rows = df.select("*", F.input_file_name().alias("_file"),
                     F.col("_metadata.file_block_start").cast("decimal(38,0)").alias("_at"),
                     F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    place = F.col("_at") * F.expr(f"CAST('{_SPLIT_PLACE}' AS DECIMAL(38,0))") + F.col("_row")
    return _numbered(rows, files, number_from, place).drop("_file", "_at", "_row", "_number")


def _parquet_in_file_order(df: DataFrame, files: Sequence[str]) -> DataFrame:
    """Adds ``row_seq`` to the rows of Parquet files, which know their own number.

    That number is a value like any other, so filters on the rows still reach the scan.
    """
    # a path without a host is written with one slash or with three
    names = [f.replace(":///", ":/", 1) for f in files]
    name = F.regexp_replace(F.col("_metadata.file_path"), "^([^:/]+):///", "$1:/")
    rows = df.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return _numbered(rows, names, 0, F.col("_row").cast("decimal(38,0)")).drop("_file", "_row", "_number")


def csv_reader(spark: SparkSession, multiline: bool = False) -> DataFrameReader:
    """Quoted fields may hold separators and, doubled, quotes; with ``multiline`` line breaks as well.

    A file with line breaks in fields can't be split, so a task reads it whole.
    """
    return (spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
            .option("quote", '"').option("escape", '"').option("multiLine", multiline))


def _read_csv(spark: SparkSession, path: str, number_from: int, multiline: bool) -> tuple[DataFrame, int]:
    """The rows of one path as text, numbered if they bring no numbers, and the files counted so far."""
    raw = csv_reader(spark, multiline).option("mode", "FAILFAST").csv(path)
    if S.ROW_SEQ in raw.columns:
        return raw, number_from
    files = sorted(raw.inputFiles())
    return in_file_order(raw, files, number_from), number_from + len(files)


def read_inventory(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv", strict: bool = True,
                   date_format: str | None = None, multiline: bool = False) -> DataFrame:
    """Read an inventory table; returns the typed, validated DataFrame.

    CSV is read with every column as text (no schema inference pass over the
    data), missing-value text is normalised, then columns are cast.  The files
    of one path must share one header, or the read fails; several paths may
    have their columns in different order.  Quoted fields may hold commas and
    doubled quotes; with ``multiline`` line breaks too.  The dates of a path have
    one format, elected in a pass over that column (``sources.dates``), or the
    Spark pattern ``date_format``, and then there is no such pass.  Parquet is read
    with its own types.  A ``row_seq`` column in the file is kept as the file order;
    without one, rows are numbered by path, file name and place in the file.  Other
    extra columns are dropped from CSV.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "csv":
        df, files = None, 0
        for p in paths:
            raw, files = _read_csv(spark, p, files, multiline)
            texts = normalise_missing(_rename_headers(raw), text=True)
            form = date_format
            if not form and S.OBS_DATE in texts.columns:
                form = dates.elect(texts.select(S.OBS_DATE), S.OBS_DATE, strict=strict)
            part = _typed(texts, strict, form or dates.ISO)
            df = part if df is None else df.unionByName(part)
    elif fmt == "parquet":
        raw = spark.read.parquet(*paths)
        if S.ROW_SEQ not in raw.columns:
            raw = _parquet_in_file_order(raw, sorted(raw.inputFiles()))
        df = normalise_missing(_rename_headers(raw))
    else:
        raise ValueError(f"unsupported inventory format: {fmt}")
    return S.validate_schema(df)


def by_date(rows: DataFrame, dates: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Deals ``rows`` into partitions of successive dates, of about ``rows_per_file`` rows each.

    Spark's own range partitioning computes the rows twice, once for a sample of them.
    Here the places come from ``dates``, a cheap table with about as many rows of each
    date: a date starts in the partition that the rows of the dates before it fill, and one
    of more rows than a partition holds is spread over several.  The window is over a
    row for each distinct date.
    """
    total = dates.count()
    parts = max(1, -(-total // rows_per_file))
    filled = lambda n: F.floor(n * F.lit(parts) / F.lit(max(total, 1))).cast("int")
    n = F.coalesce(F.sum("_n").over(Window.orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = dates.groupBy(F.col(S.OBS_DATE).alias("_date")).agg(F.count(F.lit(1)).alias("_n")) \
        .select("_date", F.least(filled(n), F.lit(parts - 1)).alias("_first"),
                F.least(filled(n + F.col("_n") - 1), F.lit(parts - 1)).alias("_last"))
    placed = rows.join(F.broadcast(places), F.col(S.OBS_DATE).eqNullSafe(F.col("_date")), "left")
    spread = F.pmod(F.xxhash64(*rows.columns), F.col("_last") - F.col("_first") + 1).cast("int")
    return placed.withColumn("_part", F.coalesce(F.col("_first") + spread, F.lit(0))) \
        .repartitionById(parts, "_part").select(*rows.columns)


def save_enriched(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                  files: int | None = None, mode: str = "overwrite", dates: DataFrame | None = None,
                  order: Sequence[Column] = (), derive: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Store an (enriched) inventory table as Parquet.

    ``files``: range-cluster the rows by date into that many files, or as many
    as adaptive execution finds right if 0 (one sampling pass plus one shuffle).  Each file then covers a date range, so
    Parquet min/max statistics let date filters such as the latest snapshot
    skip whole files, and later scans get one split per file.  Without it the
    input partitioning is kept and no shuffle is added.  For a table of many
    days, ``partition_by=("obs_date",)`` adds directory pruning instead.
    Rows are sorted by date and file order inside each file.

    ``dates`` deals the rows by date without the sampling pass (``by_date``).  ``derive``
    makes the table to store of the rows of ``df``, row by row, after they are dealt
    and sorted: ``df`` then has the date and whatever ``derive`` needs, and ``order`` is its
    file order within a date.
    """
    if dates is not None:
        df = by_date(df, dates)
    elif files is not None:
        keys = [F.col(S.OBS_DATE), F.col(S.ROW_SEQ)]
        df = df.repartitionByRange(int(files), *keys) if files else df.repartitionByRange(*keys)
    elif partition_by:  # else each task writes a file for each of its dates
        df = df.repartition(*partition_by)
    if order:
        keys = {f"_order{i}": c for i, c in enumerate(order)}
        df = df.withColumns(keys).sortWithinPartitions(S.OBS_DATE, *keys).drop(*keys)
    else:
        df = df.sortWithinPartitions(S.OBS_DATE, S.ROW_SEQ)
    writer = (derive(df) if derive else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def load_enriched(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by :func:`save_enriched`."""
    return spark.read.parquet(path)
