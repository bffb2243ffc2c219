"""Centroid clustering by dimension-sharded Lloyd rounds, in whole numbers.

A vector's components become integers ``floor(scale * x)``.  The columns are cut into
blocks of ``WIDTH`` and the rows into chunks of ``ROWS``; one record holds one column
block of one chunk.  A round has three steps:

1. each column-block record computes, against its slice of the centroids, the exact
   partial squared distances of its rows;
2. the partial distances of a chunk are added over the blocks, and each row goes to the
   nearest centroid (ties: the smaller number);
3. each column block adds its own columns by cluster, and its slice of a centroid becomes
   ``floor(sum / count)``; the slice of an empty cluster stays.

Integers make the result independent of the blocks, of the order of additions and of the
layout.  What is broadcast is the centroids' slices: ``k * dim`` longs, whatever the
input.  Each round's assignment and slices are written to the shared folder.

Edge cases: vectors that are null, of another length, or hold null or non-finite
components are left out; a component beyond 2^19 in size (2^27 when scaled) counts as
that, so that every distance is a long; sums beyond a long become the largest long; with
fewer vectors than clusters each one is a centroid; equal vectors and repeated ids are
rows of their own (equal ids with equal hashes start in the order of their components); a
row without an id is clustered, but is no first centroid; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import cut, table

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
WIDTH = 32
ROWS = 1024
#: components are held to +-BOUND before they are scaled
BOUND = 1 << 19
#: products of smaller numbers add up exactly in doubles
EXACT = 1 << 22


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id",
         vec: str = "embedding") -> DataFrame:
    """(vec_id, q) of the vectors with ``dim`` finite components; q: the scaled integers."""
    x = F.transform(F.col(vec), lambda e: e.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.size("x") == dim)
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    held = lambda e: F.greatest(F.least(e, F.lit(float(BOUND))), F.lit(float(-BOUND)))
    return rows.where(~F.exists("x", odd)) \
        .select("vec_id", F.transform("x", lambda e: F.floor(held(e) * F.lit(float(scale))).cast("int")).alias("q"))


def _shards(rows: DataFrame, dim: int, width: int) -> DataFrame:
    """(chunk, block, ids, values): one column block of one chunk of rows; the ids stand in block 0."""
    ids = T.ArrayType(rows.schema["vec_id"].dataType)
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("block", T.IntegerType()),
                           T.StructField("ids", ids), T.StructField("values", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                n = part.num_rows
                x = np.asarray(part.column(1).flatten(), np.int32).reshape(n, dim)
                lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0))
                for block, at in enumerate(range(0, dim, width)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task + number], pa.int64()), pa.array([block], pa.int32()),
                         lists if not block else pa.nulls(1, lists.type),
                         pa.array([np.ascontiguousarray(x[:, at:at + width]).tobytes()], pa.binary())],
                        names=schema.names)
                number += 1

    return rows.mapInArrow(run, schema)


def _first(rows: DataFrame, clusters: int, dim: int, width: int, seed: int) -> DataFrame:
    """(block, cluster, slice) of the first centroids: the rows with the least hashes of their ids."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = rows.select(sha.alias("sha"), "q").where("sha is not null").orderBy("sha", "q").limit(clusters)
    numbered = least.select((F.row_number().over(Window.orderBy("sha", "q")) - 1).alias("cluster"), "q")  # so many rows only
    longs = F.col("q").cast("array<bigint>")
    blocks = F.array(*[F.slice(longs, at + 1, width) for at in range(0, dim, width)])
    return numbered.select("cluster", F.posexplode(blocks).alias("block", "slice"))


def _numbers(raw: bytes, kind: str, columns: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, columns).astype(np.int64)


def partial(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the rows of ``c``, both of whole numbers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT and x.shape[1] <= 128:
        product = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        product = x @ c.T
    return (x * x).sum(axis=1)[:, None] - 2 * product + (c * c).sum(axis=1)[None, :]


def _assigned(shards: DataFrame, slices: DataFrame) -> DataFrame:
    """(chunk, cluster, distance): per chunk the nearest centroid of each of its rows."""
    per_block = slices.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("cluster", "slice"))).alias("c")) \
        .select("block", F.flatten("c.slice").alias("centroids"), F.size("c").alias("k"))
    both = shards.select("chunk", "block", "values").join(F.broadcast(per_block), "block")
    parts = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("k", T.IntegerType()),
                          T.StructField("part", T.BinaryType())])

    def measure(batches):
        for batch in batches:
            column = {f: batch.column(f) for f in ("values", "centroids", "k")}
            out = []
            for i in range(batch.num_rows):
                k = column["k"][i].as_py()
                c = np.asarray(column["centroids"][i].values, np.int64).reshape(k, -1)
                d = partial(_numbers(column["values"][i].as_py(), "<i4", c.shape[1]), c)
                kind = "<u4" if d.max(initial=0) < 1 << 32 else "<i8"  # four bytes do for most
                out.append(len(d).to_bytes(4, "little") + d.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("k"), pa.array(out, pa.binary())],
                                             names=parts.names)

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("cluster", T.ArrayType(T.IntegerType())),
                           T.StructField("distance", T.ArrayType(T.LongType()))])

    def nearest(group: pa.Table) -> pa.Table:
        total = 0
        for raw, k in zip(group.column("part").to_pylist(), group.column("k").to_pylist()):
            rows = int.from_bytes(raw[:4], "little")
            total = total + _numbers(raw[4:], "<u4" if len(raw) - 4 == 4 * rows * k else "<i8", k)
        cluster = total.argmin(axis=1)  # the first of equal ones
        distance = total[np.arange(len(cluster)), cluster]
        return pa.table({"chunk": group.column("chunk").slice(0, 1),
                         "cluster": pa.array([cluster.astype(np.int32)], pa.list_(pa.int32())),
                         "distance": pa.array([distance], pa.list_(pa.int64()))})

    # a chunk's group is one record for each column block
    return both.select("chunk", "values", "centroids", "k").mapInArrow(measure, parts) \
        .groupBy("chunk").applyInArrow(nearest, schema)


def _updated(shards: DataFrame, assigned: DataFrame, slices: DataFrame) -> DataFrame:
    """The centroids' slices after each column block has taken the means of its columns."""
    both = shards.select("chunk", "block", "values").join(assigned.select("chunk", "cluster"), "chunk")
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("cluster", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}  # of a task: a count and the sums, by block and cluster
        for batch in batches:
            for block, raw, labels in zip(batch.column("block").to_pylist(), batch.column("values").to_pylist(),
                                          batch.column("cluster")):
                label = np.asarray(labels.values, np.int64)
                x = _numbers(raw, "<i4", len(raw) // 4 // len(label))
                order = np.argsort(label, kind="stable")
                own, begin = np.unique(label[order], return_index=True)
                counted = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
                for c, s in zip(own.tolist(), np.add.reduceat(counted[order], begin, axis=0)):
                    sums[block, c] = sums[block, c] + s if (block, c) in sums else s
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()),
                 pa.array([int(sums[k][0]) for k in keys], pa.int64()),
                 pa.array([sums[k][1:] for k in keys], pa.list_(pa.int64()))], names=schema.names)

    added = both.select("block", "values", "cluster").mapInArrow(add, schema) \
        .select("block", "cluster", "n", F.posexplode("sums").alias("dim", "s")) \
        .groupBy("block", "cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    mean = F.expr("cast((s - pmod(s, cast(n as decimal(20,0)))) div n as bigint)")  # the floor, negative sums as well
    fresh = added.select("block", "cluster", F.struct("dim", mean.alias("v")).alias("d")) \
        .groupBy("block", "cluster").agg(F.sort_array(F.collect_list("d")).alias("d")) \
        .select("block", "cluster", F.col("d.v").alias("fresh"))  # one row per block and cluster
    return slices.join(fresh, ["block", "cluster"], "left") \
        .select("block", "cluster", F.coalesce("fresh", "slice").alias("slice"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, width: int = WIDTH,
            scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id",
            vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of every kept row, and (cluster, block, slice) of the last centroids."""
    rows = kept(vectors, dim, scale, id_col, vec)
    shards = cut(_shards(rows, dim, width), "shards")
    slices = cut(_first(rows, clusters, dim, width, seed), "slices")
    for _ in range(rounds):
        slices = cut(_updated(shards, cut(_assigned(shards, slices), "assigned"), slices), "slices")
    last = cut(_assigned(shards, slices), "assigned")
    named = shards.where("block = 0").select("chunk", "ids").join(last, "chunk") \
        .select(F.inline(F.arrays_zip("ids", "cluster", "distance"))).toDF("vec_id", "cluster", "distance")
    return named, slices


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    rows, slices = cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    long_ = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(2 ** 63 - 1)).cast("long")
    per = cut(rows.groupBy("cluster").agg(long_("distance").alias("cluster_inertia")), "inertia")
    total = per.agg(long_("cluster_inertia")).first()[0]
    digest = slices.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("block", "slice"))).alias("c")) \
        .select("cluster", F.sha2(F.array_join(F.flatten("c.slice").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    # a row for each cluster
    return rows.join(F.broadcast(per.join(digest, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """The rounds written out one after another."""
    nearest = """a{r} as materialized (
  select rid, (m % 1000)::int as cluster, (m // 1000)::bigint as distance from (
    select rid, min(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * 1000
                    + c.cluster) as m from v, c{r} c group by rid))"""
    means = """c{s} as materialized (
  select c.cluster, coalesce(f.q, c.q) as q from c{r} c left join (
    select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as q from (
      select cluster, i, sum(x) as s, count(*) as n from (
        select a.cluster, unnest(v.q) as x, unnest(range(1, 65)) as i from a{r} a join v on v.rid = a.rid) group by all)
    group by cluster) f on f.cluster = c.cluster)"""
    steps = [nearest.format(r=0)]
    for r in range(rounds):
        steps += [means.format(r=r, s=r + 1), nearest.format(r=r + 1)]
    return f"""
with v as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select (row_number() over (order by sha256('2:' || vec_id), q) - 1)::int as cluster, q from v
  where vec_id is not null qualify cluster < {CLUSTERS}),
{', '.join(steps)},
n as (select cluster, sum(distance)::bigint as cluster_inertia from a{rounds} group by cluster)
select v.vec_id, a.cluster, a.distance, n.cluster_inertia, (sum(a.distance) over ())::bigint as inertia,
  sha256(array_to_string(c.q, ',')) as centroid_sha256
from a{rounds} a join v on v.rid = a.rid join n on n.cluster = a.cluster join c{rounds} c on c.cluster = a.cluster
"""


ORACLE_SQL = {"op13_centroids": _sql()}
