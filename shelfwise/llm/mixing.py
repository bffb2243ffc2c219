"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: the sources share the total size by weight; a source's target stops at
``max_repeat`` times its size and the excess is shared out again until none is
above.  Large sources are split into shards of bounded size by a seeded hash of
the document and, of equal rows, a running number, so that they spread as well.
Blocks of equally many words go to the shards by the highest quotients
``target / (2 k + 1)``, which gives each an integer quota.  A shard's documents lie end to end in a seeded order; its quota is spent on whole passes
over the shard and, for the rest, on one cyclic run of blocks that begins at a
seeded block.  So a document is taken whole or not at all in that run, except at
its two ends, and a run of the program gives the same mix again.

The quotients are searched by their common divisor with a few aggregations over
the table of shards; only sums and a handful of tied shards reach the driver.

Edge cases: a null or blank text has size 0 and nothing is taken; documents with
a null source form one source, last in order; repeated rows and ids are separate
rows of the mix; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18
MAX_REPEAT = 3
SEED = 42
_TRIES = 64


def source_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the cycle repeated along the sources in code-point order, null last."""
    s = cut(sources.orderBy(F.col("source").asc_nulls_last())
            .withColumn("mid", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("mid", 33), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    s = s.withColumn("part", part).withColumn("place", place)
    # one row per partition of the sort, not per source
    sizes = s.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = (F.col("before") + F.col("place")) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (at + 1).cast("int"))
    return s.join(before, "part").withColumn("weight", weight).drop("mid", "part", "place", "before")


def targets(sources: DataFrame, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight)."""
    s = cut(sources, "weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(max_repeat)
    rate = 0.0
    while True:  # the rate only grows, and each round stops at least one more source
        over = F.col("weight") * rate >= cap
        spent, weight = s.agg(F.sum(F.when(over, cap).otherwise(0.0)),
                              F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        fresh = (total - spent) / weight if weight else rate
        if fresh <= rate:
            return s.withColumn("target", F.least(cap, F.col("weight") * rate))
        rate = fresh


def apportion(units: DataFrame, seats: int, vote: str = "target", key: str = "unit") -> DataFrame:
    """Adds ``seats``: ``seats`` in all, to the highest quotients vote / (2 k + 1).

    Equal quotients go by ``key``.
    """
    u = cut(units, "units")
    at = lambda d: F.floor(F.col(vote) / F.lit(float(d)) + 0.5).cast("long")
    total, top = u.agg(F.sum(vote), F.max(vote)).first()
    if not seats or not total or total <= 0:
        return u.withColumn("seats", F.lit(0).cast("long"))
    lo, hi = total / (seats + u.count()) / 2, 2 * top + 1  # too many seats at lo, too few at hi
    for _ in range(12):
        tries = [lo + (hi - lo) * i / _TRIES for i in range(1, _TRIES)]
        found = u.agg(*[F.sum(at(d)).alias(f"s{i}") for i, d in enumerate(tries)]).first()
        for d, n in zip(tries, found):
            if n > seats:
                lo = max(lo, d)
            elif d < hi:
                hi = d
        if max(found) <= seats and min(found) == seats or hi - lo <= 1e-12 * hi:
            break
        if any(n == seats for n in found):
            break
    base = u.withColumn("seats", at(hi))
    left = seats - (base.agg(F.sum("seats")).first()[0] or 0)
    if left <= 0:
        return base
    quotient = F.col(vote) / (2 * F.col("seats") + 1)
    extra = base.where(F.col(vote) > 0).orderBy(quotient.desc(), key).limit(int(left)).select(key, F.lit(1).alias("one"))
    return base.join(cut(extra, "extra"), key, "left") \
        .withColumn("seats", F.col("seats") + F.coalesce("one", F.lit(0))).drop("one")


_KEY = ("doc_id", "source", "name", "size", "hash")
_RUN = 1 << 16


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each of ``n``, with its number ``copy`` from ``begin``; no array is longer than _RUN."""
    first = F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1, F.lit(_RUN).cast("long")))
    last = F.least(F.col("from") + (_RUN - 1), F.col("begin") + F.col("n") - 1)
    return rows.withColumn("from", first).withColumn("copy", F.explode(F.sequence(F.col("from"), last))) \
        .drop("n", "begin", "from")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``copy``, a number from 0 for each of the rows that are equal; they are counted before they are shuffled."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    return _copies(counted.withColumn("begin", F.lit(0).cast("long")))


def _carried(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """``_numbered`` for rows with texts: only those whose key occurs again are grouped.

    Rows of one key that differ in another carried column are numbered together.
    """
    again = sized.where("size > 0").groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1")
    again = cut(again.select(*[F.col(c).alias(f"k_{c}") for c in _KEY]), "again")
    same = F.lit(True)
    for c in _KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    several = rows.join(again, same, "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("n"))
    # of one key: where the copies of each of its different rows begin
    kinds = cut(several.withColumn("kind", F.xxhash64(F.to_json("row"))), "several")
    w = Window.partitionBy(*_KEY).orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n").over(w), F.lit(0))
    numbered = _copies(kinds.withColumn("begin", begin).drop("kind"))
    return rows.join(again, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(numbered)


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_repeat: int = MAX_REPEAT,
        cycle: tuple[int, ...] = (1, 2, 3), seed: int = SEED, id_col: str = "doc_id", text: str = "text",
        source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and how: ``passes`` whole
    copies and the word spans ``spans`` (from, to) of the partial one.

    ``carry`` names columns, such as the text, that go along with their row to its
    shard, as a struct ``row``; no join by id is needed then.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))  # null is a source of its own
    columns = [F.col(id_col).alias("doc_id"), F.col(source).alias("source"), name.alias("name"), size.alias("size"),
               F.xxhash64(F.col(text)).alias("hash")]
    sized = cut(docs.select(*columns), "sizes")
    per = sized.groupBy("name").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(source_weights(per, cycle), max_repeat) \
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    goal = cut(goal.select("name", "source_size", "target", "shards"), "goal")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(goal, "name").withColumn("order", F.xxhash64("doc_id", "size", "hash", "copy", F.lit(seed))) \
            .withColumn("unit", F.concat_ws("/", F.pmod(F.xxhash64("order"), F.col("shards")).cast("string"), "name")) \
            .drop("name", "source", "shards", "copy")

    rows = cut(dealt(_numbered(sized)), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    units = rows.groupBy("unit").agg(F.sum("size").alias("unit_size"), F.first("source_size").alias("s"),
                                     F.first("target").alias("t"))
    units = units.select("unit", "unit_size", F.coalesce(
        F.try_divide(F.col("t") * F.col("unit_size"), F.col("s")), F.lit(0.0)).alias("target"))
    quota = F.least(F.col("seats") * block, F.col("unit_size") * max_repeat)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("unit_size") / block)).cast("long")
    units = apportion(units, round(total / block)).withColumn("quota", quota).select(
        "unit", "unit_size",
        F.coalesce(F.expr("try_divide(quota - mod(quota, greatest(unit_size, 1)), unit_size)"), F.lit(0))
        .cast("long").alias("passes"),
        F.expr("mod(quota, greatest(unit_size, 1))").alias("rest"),
        (F.pmod(F.xxhash64("unit", F.lit(seed)), blocks) * block).alias("run"))
    some, none = rows.where("size > 0"), rows.where("size = 0")
    if carry:
        blank = F.col(text).isNull() | ~F.col(text).rlike(WORD)
        own = lambda c: docs.where(c).select(*columns, F.struct(*carry).alias("row"))
        some, none = dealt(_carried(own(~blank), sized)), dealt(own(blank).withColumn("copy", F.lit(0).cast("long")))
    quotas = cut(units, "quotas")
    w = Window.partitionBy("unit").orderBy("order", "doc_id", "size", "hash") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = some.join(quotas, "unit").withColumn("off", F.coalesce(F.sum("size").over(w), F.lit(0))) \
        .unionByName(none.join(quotas, "unit").withColumn("off", F.lit(0).cast("long")))  # a shard has any number of these
    # the run, and what of it goes on from the shard's beginning, in words of this document
    clip = lambda x: F.least(F.greatest(x - F.col("off"), F.lit(0)), F.col("size"))
    end = F.col("run") + F.col("rest")
    spans = F.array(F.struct(clip(F.lit(0).cast("long")).alias("from"), clip(end - F.col("unit_size")).alias("to")),
                    F.struct(clip(F.col("run")).alias("from"), clip(end).alias("to")))
    placed = placed.withColumn("spans", F.filter(spans, lambda s: s["to"] > s["from"]))
    partial = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return placed.select("doc_id", "size", "source_size", "target",
                         (F.col("passes") * F.col("size") + partial).alias("taken"), "passes", "spans",
                         *(["row"] if carry else []))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")) \
        .select("doc_id", "size", "source_size", "target", "taken", "passes")
