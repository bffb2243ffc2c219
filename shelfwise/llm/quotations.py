"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (leading ``>`` marks).  Each run
of lines of one level is a passage; the passage, its paragraphs and its lines,
normalised (lower case, white space squeezed), are hashed and joined to the same
units of what earlier messages of the conversation wrote themselves.  A quoted
unit points at the latest earlier message that has it, so text quoted from a
quotation points past it to its author.  The message that most quoted text of
the outermost level points at is the one replied to; ``thread`` is the message
at the root of the replies.  ``conversations`` builds the conversations: their
messages by (thread, turn), so every reply stands behind what it answers and the
threads follow one another; the quotes and the lines that announce them
("... wrote:") are left out of the text.

The latest earlier message is found per bucket of turns and carried from bucket
to bucket, so a line that every message of a huge conversation has or quotes
meets no single task.  A conversation is built in rows of at most ``PART`` messages,
numbered from 0; its messages' places come from one sort by range of all messages, so
that a conversation of any length is dealt over many tasks.

Edge cases: a null or empty text is an empty message, and one that is all quotes
keeps an empty text; equal lines point at the latest earlier one; repeated rows
get equal results, and two different messages of one turn are told apart by
their text; rows with a null conversation or turn are linked with nothing; a
message of no conversation is one of its own, one without a turn stands last in its
conversation; equal messages are messages each; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import cut, let, table

BUCKET = 1024  # turns
PART = 256  # messages in a row of a conversation
_MARKS = r"^(?:[ \t]*>)+"
_SAYS = r"(?i)^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"


def _lines(text: Column) -> Column:
    marks = lambda x: F.regexp_extract(x, _MARKS, 0)
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.struct(
        F.length(F.regexp_replace(marks(x), r"[^>]", "")).alias("level"),
        F.regexp_replace(x, _MARKS + r"[ \t]?", "").alias("body")))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _units(body: Column) -> Column:
    """The normalised passage, its paragraphs and its lines, without blanks and repetitions."""
    parts = F.concat(F.array(body), F.split(body, r"\n\s*\n"), F.split(body, r"\n"))
    return F.array_distinct(F.filter(F.transform(parts, _plain), lambda u: u != ""))


def _parsed(rows: DataFrame) -> DataFrame:
    """Adds the message's own text and its passages (level, body)."""
    def body(ls):
        return F.array_join(F.transform(ls, lambda x: x["body"]), "\n")

    def own(ls):
        says = lambda x, i: x["body"].rlike(_SAYS) & F.coalesce(F.get(ls, i + 1)["level"] > 0, F.lit(False))
        return F.trim(body(F.filter(ls, lambda x, i: (x["level"] == 0) & ~says(x, i))), F.lit(" \t\r\n"))

    def passages(ls):
        heads = F.filter(F.sequence(F.lit(0), F.size(ls)), lambda i: (i == F.size(ls)) | (i == 0) | (
            F.get(ls, i)["level"] != F.get(ls, i - 1)["level"]))
        return let(heads, lambda h: F.filter(
            F.transform(F.slice(h, 1, F.size(h) - 1), lambda a, k: F.struct(
                F.get(ls, a)["level"].alias("level"),
                body(F.slice(ls, a + 1, F.get(h, k + 1) - a)).alias("body"))),
            lambda p: (p["level"] > 0) & (p["body"] != "")))

    both = let(_lines(F.col("text")), lambda ls: F.struct(
        own(ls).alias("own"), passages(ls).alias("passages"), F.array_max(ls["level"]).alias("levels")))
    return rows.withColumn("p", both).select(*rows.columns, "p.own", "p.passages", "p.levels")


def _latest(originals: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (conv_id, h, turn): the latest earlier original turn, if any."""
    on = ["conv_id", "h", "bucket"]
    bucket = F.floor(F.col("turn") / BUCKET).alias("bucket")
    have = cut(originals.select("conv_id", "h", "turn", bucket).distinct(), "originals")
    want = cut(asked.select("conv_id", "h", "turn", bucket).distinct(), "asked")
    per = have.groupBy(*on).agg(F.max("turn").alias("top"))
    ends = per.unionByName(want.select(*on).distinct().withColumn("top", F.lit(None).cast("long"))) \
        .groupBy(*on).agg(F.max("top").alias("top"))
    w = Window.partitionBy("conv_id", "h").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut(ends.select(*on, F.max("top").over(w).alias("carried")), "carried")
    near = have.withColumn("at", F.col("turn")).unionByName(want.withColumn("at", F.lit(None).cast("long")))
    before = Window.partitionBy(*on).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = near.select(*on, "turn", "at", F.max("at").over(before).alias("near")).where("at is null")
    return cut(near, "near").join(carry, on).select(
        "conv_id", "h", "turn", F.coalesce("near", "carried").alias("target")).where("target is not null")


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of messages that reply, by doubling along the replies."""
    now = cut(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")),
              "replies")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"),
                        F.col("depth").alias("more"))
        far = cut(now.join(up, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("above", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")),
            "threads")
        now = far.drop("moved")
        if far.where("moved").isEmpty():
            return now


def link_quotations(messages: DataFrame) -> DataFrame:
    """Per row: conv_id, turn, role, text without quotes, n_quotes, levels, quoted
    (level, turn) links, reply_to, thread and depth.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text") \
        .withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))
    rows = cut(_parsed(rows).drop("text"), "parsed")
    linked = rows.where("conv_id is not null and turn is not null")
    quoted = linked.where(F.size("passages") > 0).select(
        "conv_id", "turn", "row", F.explode("passages").alias("q")).select(
        "conv_id", "turn", "row", "q.level", F.explode(_units(F.col("q.body"))).alias("unit"))
    quoted = cut(quoted.select("conv_id", "turn", "row", "level", F.xxhash64("unit").alias("h"),
                               F.length("unit").cast("long").alias("n")), "quoted")
    asked = cut(quoted.select("conv_id", "h").distinct(), "units")
    originals = linked.select("conv_id", "turn", F.explode(_units(F.col("own"))).alias("unit")) \
        .select("conv_id", "turn", F.xxhash64("unit").alias("h")).join(asked, ["conv_id", "h"], "left_semi")
    target = cut(_latest(originals, quoted), "targets")
    votes = quoted.join(target, ["conv_id", "h", "turn"]) \
        .groupBy("conv_id", "turn", "row", "level", "target").agg(F.sum("n").alias("n"))
    links = votes.groupBy("conv_id", "turn", "row").agg(
        F.max_by("target", F.struct(-F.col("level"), F.col("n"), F.col("target"))).alias("reply_to"),
        F.sort_array(F.collect_set(F.struct("level", F.col("target").alias("turn")))).alias("quoted"))
    links = cut(links, "links")
    # of several messages with one turn, the thread follows the one that replies furthest back
    threads = _threads(links.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to")))
    out = rows.join(links, ["conv_id", "turn", "row"], "left").join(threads, ["conv_id", "turn"], "left")
    mine = F.col("reply_to").isNotNull()
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("passages").cast("long").alias("n_quotes"),
        F.col("levels").cast("long").alias("levels"), "quoted", "reply_to",
        F.when(mine, F.col("thread")).otherwise(F.col("turn")).alias("thread"),
        F.when(mine, F.col("depth")).otherwise(F.lit(0)).cast("long").alias("depth"))


def _places(messages: DataFrame) -> DataFrame:
    """Adds ``place``, the number of a message within its conversation from 0, in reply order."""
    # equal messages are interchangeable: the number of their row in the written table parts them
    rows = cut(messages, "linked").withColumn("number", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last(),
             F.xxhash64("role", "text"), F.col("number")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("number")
    at = F.monotonically_increasing_id()
    rows = cut(rows.withColumn("task", F.spark_partition_id()).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    # one row for each partition of the sort
    counts = rows.groupBy("task").agg(F.count("*").alias("n"))
    before = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    rows = rows.join(F.broadcast(cut(before, "before")), "task").withColumn("at", F.col("at") + F.col("before"))
    first = rows.where("conv_id is not null").groupBy(F.col("conv_id").alias("of")).agg(F.min("at").alias("first"))
    place = F.col("at") - F.coalesce("first", "at")
    return rows.join(cut(first, "first"), F.col("conv_id") == F.col("of"), "left") \
        .withColumn("alone", F.when(F.col("conv_id").isNull(), F.col("at"))) \
        .withColumn("place", place).drop("task", "before", "of", "first", "at")


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """Conversations in reply order: conv_id, part, n_messages and messages, of what ``link_quotations`` gives.

    A message is (place, turn, role, text, n_quotes, levels, reply_to, thread, depth).
    """
    fields = ["place", "turn", "role", "text", "n_quotes", "levels", "reply_to", "thread", "depth"]
    number = (F.col("place") - F.col("place") % part) / part
    return _places(messages.select("conv_id", *fields[1:])) \
        .groupBy("conv_id", "alone", number.cast("long").alias("part")) \
        .agg(F.count("*").alias("n_messages"), F.sort_array(F.collect_list(F.struct(*fields))).alias("messages")) \
        .drop("alone")


def op2_quotations(spark, sf_dir: str) -> DataFrame:
    return conversations(link_quotations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
