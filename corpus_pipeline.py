"""A training corpus from ``documents``: rules, near-dedup, substring dedup, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared checkpoint folder, hands it to the next and removes
what is no longer read.  All but the last return the columns of ``documents``.
Nulls, empty texts and empty tables follow the rules in each operator's docstring.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import level_dedup, mixing, packing, quality_rules, setsketch
from shelfwise.llm.common import cut, release, table, written, written_since

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    docs = docs.select(*COLUMNS)
    return quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), the smallest id.

    Rows that share an id are told apart by all of their columns: equal ones become one,
    others are documents of their own.  Rows without an id all stay.
    """
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id is not null").withColumn("row", F.xxhash64(*COLUMNS, *[F.isnull(c) for c in COLUMNS]))
    # a number per distinct row, ascending with the id: the smallest number has the smallest id
    numbers = named.select("doc_id", "row").distinct().orderBy("doc_id", "row") \
        .withColumn("key", F.monotonically_increasing_id())
    keyed = cut(named.join(cut(numbers, "numbers"), ["doc_id", "row"]).select("key", *COLUMNS), "keyed")
    kept = setsketch.near_dedup(keyed, size=5, percent=80, id_col="key").where("kept") \
        .select(F.col("doc_id").alias("key")).distinct()
    one = keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)
    return one.unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a smaller id has; texts left empty go.

    Rows that share an id each get what is left of their own text.
    """
    docs = docs.select(*COLUMNS)
    changed = level_dedup.substring_dedup(docs, with_text=True).where("n_removed > 0") \
        .select(F.col("doc_id").alias("id"), F.col("row").alias("of"), F.col("kept_text")).dropDuplicates(["id", "of"])
    out = docs.join(cut(changed, "changed"), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("of")), "left") \
        .where("id is null or kept_text <> ''")
    text = F.when(F.col("id").isNotNull(), F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("n_chars", F.when(F.col("id").isNotNull(), F.length("kept_text").cast("long"))
                          .otherwise(F.col("n_chars"))) \
        .withColumn("text", text).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole copy of a document and one for each span that the mix takes of it."""
    taken = mixing.mix(docs.select(*COLUMNS), carry=COLUMNS).where("taken > 0")
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("passes", F.lit(1))), lambda i: F.struct(
        F.lit(0).cast("long").alias("from"), F.col("size").alias("to")))
    parts = F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.array().cast(
        "array<struct<from:bigint,to:bigint>>")), F.col("spans"))
    rows = taken.select("row.*", "size", F.explode(parts).alias("part"))
    words = F.filter(F.split("text", quality_rules.BLANKS), lambda w: w != "")
    span = F.concat_ws(" ", F.slice(words, (F.col("part.from") + 1).cast("int"),
                                    (F.col("part.to") - F.col("part.from")).cast("int")))
    full = (F.col("part.to") - F.col("part.from")) == F.col("size")
    return rows.withColumn("n_chars", F.when(full, F.col("n_chars")).otherwise(F.length(span).cast("long"))) \
        .withColumn("text", F.when(full, F.col("text")).otherwise(span)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their tokens and their places in sequences of 2048 tokens."""
    return packing.packed_tokens(docs)


#: By number of the stage that ran last: the tables that it wrote on the way to the shared folder.
_LEFT: dict[int, list[str]] = {}


def _freeing(number: int, stage):
    """A stage that first removes what the stage before it has just left, if its docs were written and reread.

    So the result of a stage has to be written before the next stage is called.
    """
    @functools.wraps(stage)
    def freed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, keep=docs, only=_LEFT.get(number - 1, []))
        before = written()
        out = stage(spark, docs, sf_dir)
        _LEFT.clear()
        _LEFT[number] = written_since(before)
        return out
    return freed


STAGES = [(name, _freeing(number, stage)) for number, (name, stage) in enumerate((
    ("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
    ("mixing", mix), ("packing", pack)))]

#: The tokens of the last stage and the sketches of the second aren't expressible in SQL;
#: tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, keep=docs, since=before)  # the stage's input and what it wrote on the way
    return docs
