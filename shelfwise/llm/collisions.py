"""Embedding near-dedup by collision counts over projections.

Vectors are compared by cosine.  A vector is represented by ``PROJECTIONS`` random
one-dimensional projections, each kept in one byte.  Two vectors collide on a projection
if they lie in each other's window on it; a pair that collides on at least ``need`` of
them is verified in double precision, and every pair found near enough counts.

Counting all pairs would be quadratic, so rows first meet in the cells of several
tables, each made by the signs of ``bits`` more projections.  ``bits`` grows with the
logarithm of the rows, so cells keep their size, and the number of tables and ``need``
follow from what a pair exactly at the bound does: it shares a cell and passes the count
with the recall asked for, closer pairs more often.

Only bytes of projections are dealt to the cells.  A cell's task counts its pairs and
names the rows that have a partner; their vectors then come to a second task of the
same cell, which verifies the pairs that pass the count.  A cell larger than a block is
compared block by block, so no task holds more than two blocks.  A pair is verified in
the first table in which it shares a cell, and a task returns for each vector its number
of links and one edge towards its component, never the pairs themselves.  Equal vectors
form one class first.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths don't link; equal
rows link, also when they repeat an id (``n_links`` then counts rows); a null id
is a vector like any other for others' counts, but its row belongs to no
component (null, kept); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import components, cut, table

CELL = 512  # rows a cell should hold
BLOCK = 2048
RECALL = 0.97
PROJECTIONS = 48
WINDOW = 1.2  # half width, in standard deviations of the difference of a pair at the bound
STEP = 1 / 28  # of a projection, in units of its standard deviation, that one byte tells apart
MIDDLE, MOST = 100, 200  # bytes of the projections 0 and, at most, 100 steps
SEED = 7
STRIPE = 64
TASK = ("t", "cell", "b1", "b2")


def width(bound: float) -> int:
    """Half the window, in steps; less than 56 of them, so that differences don't wrap around a byte."""
    return min(55, max(1, round(WINDOW * math.sqrt(2 - 2 * bound) / STEP)))


def _at_least(k: int, n: int, p: float) -> float:
    """The probability of ``k`` or more of ``n``."""
    return sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k, n + 1))


def calibrate(rows: int, bound: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits, tables, need) for so many rows."""
    bits = max(0, math.ceil(math.log2(max(rows, 1) / CELL)))
    share = math.sqrt(recall)  # of the count and of the tables
    apart = math.sqrt(max(2 - 2 * bound, 1e-12))
    hit = math.erf(width(bound) * STEP / apart / math.sqrt(2))
    need = max(k for k in range(1, PROJECTIONS + 1) if k == 1 or _at_least(k, PROJECTIONS, hit) >= share)
    left = recall / _at_least(need, PROJECTIONS, hit)
    same = (1 - math.acos(bound) / math.pi) ** bits
    tables = 1
    while 1 - (1 - same) ** tables < left:
        tables += 1
    return bits, tables, need


def directions(dim: int, count: int, kind: int) -> np.ndarray:
    """(dim, count) random directions, the same on every executor."""
    return np.random.default_rng([SEED, kind, dim, count]).standard_normal((dim, count))


def _valid(docs: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(vec_id, v, ok): the vector as little-endian doubles where it can link."""
    schema = T.StructType([T.StructField("vec_id", docs.schema[id_col].dataType), T.StructField("v", T.BinaryType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.float64())
            value = flat.to_numpy(zero_copy_only=False)  # null components become NaN
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(n)])
            out = []
            for i in range(batch.num_rows):
                x = value[at[i]:at[i + 1]]
                scale = np.abs(x).max() if len(x) else 0.0
                if not (np.isfinite(x).all() and scale > 0):
                    out.append(None)
                    continue
                out.append((x + 0.0).astype("<f8").tobytes())  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("v")).mapInArrow(run, schema)


def _unit(v: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(v.to_pylist()), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coded(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """Adds the cell in every table and the bytes of the projections."""
    schema = T.StructType(reps.schema.fields + [
        T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("q", T.BinaryType())])

    def run(batches):
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            dims = pc.divide(pc.binary_length(batch.column("v")), 8).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                unit = _unit(part.column("v"), dim)
                sides = (unit @ directions(dim, bits * tables, 1) > 0).reshape(len(unit), tables, bits)
                cells = sides @ (1 << np.arange(bits, dtype=np.int64)) + (dim << bits)
                steps = np.rint(unit @ directions(dim, PROJECTIONS, 2) / STEP) + MIDDLE
                q = np.clip(steps, 0, MOST).astype(np.uint8)
                at = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(at, pa.array(cells.reshape(-1).astype(np.int64))),
                     pa.array([x.tobytes() for x in q], pa.binary())], names=schema.names)

    return reps.mapInArrow(run, schema)


def passing(q: np.ndarray, half: int, need: int):
    """Stripes (first row, mask) of the pairs of rows that collide on ``need`` projections or more.

    ``q``: a row of bytes for each projection.  ``mask[i, j]`` is for the rows
    first + i and first + j; each pair stands in one stripe, and no row with itself.
    """
    n = q.shape[1]
    for lo in range(0, n, STRIPE):
        hi = min(lo + STRIPE, n)
        count = np.zeros((hi - lo, n - lo), np.uint8)
        apart, close = np.empty_like(count), np.empty(count.shape, bool)
        for p in q:
            # a difference of -half to half, moved up by half, is the only one that is 2 half at most as a byte
            np.subtract((p[lo:hi] + np.uint8(half))[:, None], p[None, lo:], out=apart)
            np.less_equal(apart, 2 * half, out=close)
            count += close.view(np.uint8)
        mask = count >= need
        mask &= np.arange(n - lo)[None, :] > np.arange(hi - lo)[:, None]
        yield lo, mask


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """One row for each projection."""
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).T)


def _in_question(rows: DataFrame, half: int, need: int) -> DataFrame:
    """The rows of a cell's two blocks that have a pair which passes the count."""
    schema = T.StructType([rows.schema[c] for c in (*TASK, "rep", "mine")])

    def run(group: pa.Table) -> pa.Table:
        mine = group.column("mine").to_numpy()
        used = np.zeros(len(mine), bool)
        for lo, mask in passing(_bytes(group.column("q")), half, need):
            if group.column("b1")[0] != group.column("b2")[0]:
                mask &= mine[lo:lo + len(mask), None] != mine[None, lo:]
            used[lo:lo + len(mask)] |= mask.any(axis=1)
            used[lo:] |= mask.any(axis=0)
        return group.select([*TASK, "rep", "mine"]).filter(pa.array(used))

    return rows.select(*TASK, "rep", "mine", "q").groupBy(*TASK).applyInArrow(run, schema)


def _linked(rows: DataFrame, bound: float, half: int, need: int) -> DataFrame:
    """(rep, links, low): per task, the links of each row and its smallest linked neighbour group."""
    ids = rows.schema["rep"].dataType
    schema = T.StructType([T.StructField("rep", ids), T.StructField("links", T.LongType()), T.StructField("low", ids)])

    def run(group: pa.Table) -> pa.Table:
        t, b1, b2 = (group.column(c)[0].as_py() for c in ("t", "b1", "b2"))
        group = group.sort_by("rep")
        n = group.num_rows
        cells = np.asarray(group.column("cells").combine_chunks().flatten()).reshape(n, -1)
        v = group.column("v").combine_chunks()
        unit = _unit(v, pc.binary_length(v)[0].as_py() // 8)
        mine, size = group.column("mine").to_numpy(), group.column("c").to_numpy()
        links, root = np.zeros(n, np.int64), np.arange(n)
        pairs_a, pairs_b = [], []
        for lo, mask in passing(_bytes(group.column("q")), half, need):
            hi = lo + len(mask)
            if b1 != b2:
                mask &= mine[lo:hi, None] != mine[None, lo:]
            for earlier in cells.T[:t]:
                mask &= earlier[lo:hi, None] != earlier[None, lo:]
            if not mask.any():
                continue
            a, b = np.nonzero(mask & (unit[lo:hi] @ unit[lo:].T >= bound))
            a, b = a + lo, b + lo
            np.add.at(links, a, size[b])
            np.add.at(links, b, size[a])
            # of a row's links those to the first row of its group so far are enough
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            pairs_a.append(a)
            pairs_b.append(b)
        if pairs_a:
            a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
            while True:  # components within the task
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, b, root[a])
                low = low[low]
                if (low == root).all():
                    break
                root = low
        rep = group.column("rep").combine_chunks()
        some = pa.array(links > 0)
        return pa.table({"rep": rep.filter(some), "links": pa.array(links).filter(some),
                         "low": rep.take(pa.array(root)).filter(some)})

    return rows.groupBy(*TASK).applyInArrow(run, schema)


def near_vectors(vectors: DataFrame, bound: float = 0.9, recall: float = RECALL, id_col: str = "vec_id",
                 vec: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    rows = cut(_valid(vectors, id_col, vec).withColumn("key", F.md5("v")), "vectors")
    full = rows.where("v is not null")
    classes = full.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c"), F.first("v").alias("v"))
    classes = cut(classes, "classes")
    reps = classes.where("rep is not null")
    bits, tables, need = calibrate(reps.count(), bound, recall)
    half = width(bound)
    coded = cut(_coded(reps.select("key", "rep", "c", "v"), bits, tables), "coded")
    cells = coded.select("rep", F.posexplode("cells").alias("t", "cell"))
    large = cells.groupBy("t", "cell").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    split = cells.join(cut(large, "large"), ["t", "cell"]).groupBy("rep") \
        .agg(F.map_from_entries(F.collect_list(F.struct("t", F.ceil(F.col("m") / BLOCK).cast("int")))).alias("blocks"))
    dealt = coded.select("rep", "q", "cells").join(cut(split, "split"), "rep", "left") \
        .select("rep", "q", "blocks", F.posexplode("cells").alias("t", "cell"))
    nb = F.coalesce(F.col("blocks")[F.col("t")], F.lit(1))
    mine = F.pmod(F.xxhash64("rep", "t"), nb).cast("int")
    dealt = dealt.select("rep", "q", "t", "cell", mine.alias("mine"), F.explode(F.sequence(F.lit(0), nb - 1)).alias("other")) \
        .withColumn("b1", F.least("mine", "other")).withColumn("b2", F.greatest("mine", "other")).drop("other")
    asked = cut(_in_question(dealt, half, need), "asked")
    found = cut(_linked(asked.join(coded.select("rep", "c", "v", "cells", "q"), "rep"), bound, half, need), "found")
    labels = components(found.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = classes.join(cut(links, "links"), "rep", "left").join(labels, F.col("rep") == F.col("node"), "left") \
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).cast("long").alias("n_links"),
                F.coalesce("component", "rep").alias("component"))
    # vectors that can't link have no key, and rows without a key aren't joined
    out = rows.select("vec_id", "key").join(cut(of, "of"), "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE_SQL = {
    "op8_embedding_dedup": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v
      where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(e, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on l.a = r.b),
low as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n from links group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, low.component_id, v.vec_id = low.component_id as kept
from v join low on low.a = v.vec_id left join n on n.a = v.vec_id
""",
}
