"""Scratch tables and connected components shared by the operators."""

from __future__ import annotations

import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import scratch_path


#: Bytes of rows that go to a Python worker at a time, however long the texts are.
BATCH_BYTES = "4m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Tables that ``cut`` has written and ``release`` has not removed, oldest first.
_WRITTEN: list[str] = []


def release(spark: SparkSession, keep: DataFrame, since: int = 0, only: list[str] | None = None) -> None:
    """Remove the tables written since ``since`` (a count of them) that ``keep`` does not read.

    ``only``: the tables that may go; none goes if ``keep`` reads one of them.

    For a job that runs several operators: once the result of one is written, what
    it wrote on the way is of no more use.
    """
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    used = {hadoop(f).getParent().getName() for f in keep.inputFiles()}  # the names hold a random part
    may = _WRITTEN[since:] if only is None else [p for p in only if p in _WRITTEN]
    if only is not None and any(hadoop(p).getName() in used for p in may):
        return
    for path in may:
        at = hadoop(path)
        if at.getName() not in used:
            at.getFileSystem(conf).delete(at, True)
            _WRITTEN.remove(path)


def written() -> int:
    return len(_WRITTEN)


def written_since(before: int) -> list[str]:
    return _WRITTEN[before:]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads the files instead of recomputing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    _WRITTEN.append(path)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_KEY, before) if before else spark.conf.unset(_BATCH_KEY)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A given table, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def trim() -> None:
    """Give the memory that this process has freed back to the system, where its C library can."""
    import pyarrow
    pyarrow.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back:
        back(0)


def lean(run):
    """A function over batches whose worker, kept for later tasks, holds no freed memory after it."""
    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()
    return trimmed


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain column alias would be inlined by the optimizer and, inside a
    lambda, evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


EDGES_A_FILE = 1 << 18
#: seeds the order in which nodes are preferred
ORDER = 5


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b).

    The component is its smallest node.  Nodes are in a random but fixed order, a
    hash of their value.  Each round points every node at the first of itself and its
    neighbours and contracts the edges along these pointers.  A node that no neighbour
    prefers is gone after the round; in a random order that is half of a path's nodes and
    all but one of a star's within two rounds, so the rounds grow with the logarithm of
    the nodes whatever the ids are (a path of 10,000: 17).  Nothing is collected; each
    round's tables are written to the shared folder.
    """
    e = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .where("a <> b").distinct(), "edges")
    # few edges are written as few files; the tables of a round have no more rows than edges
    files = max(1, -(-e.count() // EDGES_A_FILE))
    place = lambda c: F.xxhash64(c, F.lit(ORDER))
    labels = None
    while labels is None or not e.isEmpty():
        first = e.groupBy("a").agg(F.min_by("b", place("b")).alias("low"), F.min(place("b")).alias("p"))
        stays = (place("a") < F.col("p")) | (place("a") == F.col("p")) & (F.col("a") < F.col("low"))
        hop = cut(first.select(F.col("a").alias("from"), F.when(stays, F.col("a")).otherwise(F.col("low")).alias("to"))
                  .coalesce(files), "hop")
        if labels is None:
            labels = hop.select(F.col("from").alias("node"), F.col("to").alias("component"))
        else:
            labels = cut(labels.join(hop, labels["component"] == hop["from"], "left")
                         .select("node", F.coalesce("to", "component").alias("component")).coalesce(files), "labels")
        ha = hop.select(F.col("from").alias("a"), F.col("to").alias("pa"))
        hb = hop.select(F.col("from").alias("b"), F.col("to").alias("pb"))
        half = e.join(ha, "a").select("b", "pa")
        e = cut(half.join(hb, "b").where("pa <> pb")
                .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct().coalesce(files), "edges")
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return cut(labels.join(least, "component").select("node", F.col("least").alias("component")).coalesce(files), "labels")
