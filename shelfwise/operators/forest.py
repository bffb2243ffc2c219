"""a random forest of regression trees grown on every training row, without a sample.

A tree sees of a row only the bin of each feature, so the rows are first counted by their
bins, together a *cell*, and their label.  That is exact: a bootstrap gives each row a
Poisson(1) weight, and the weights of n equal rows add up to Poisson(n).  The cells have the
same order and numbers whatever the table's layout, and the draws are seeded by block
of cells and tree, so neither the layout nor the number of cores changes the forest.

Bins end at exact quantiles of all rows.  Each tree's weighted cells go to one task, which
grows the tree by levels.  However many rows there are, a tree has at most ``max_bins`` cells to
the power of the number of features (16.7 million at 64 bins and 4 features), so its task is bounded.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Sequence
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators.common import shared
from shelfwise.session import scratch_path

# Workers of a cluster need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: cells of a block, whose draws are made together, and tasks at most that draw
BLOCK_BITS = 16
DRAW_TASKS = 1024
#: trees of a block that are handed on at once
TREES_A_BATCH = 8
#: cells at least that a tree's sums are made of at once
SLICE = 1 << 18
#: means closer than this part of themselves are equal but for rounding
EQUAL = 1e-12
BAGS = "tree int, block bigint, cells binary, weights binary, sums binary, squares binary"
NODES = ("tree int, node int, feature int, threshold double, left int, right int, value double, impurity double, "
         "gain double, weight double, total double, squares double")


def bin_edges(rows: DataFrame, features: Sequence[str], max_bins: int) -> list[list[tuple[float, float]]]:
    """For each feature, the neighbouring values between which its bins end: (last below, first above).

    A feature of up to ``max_bins`` values has a bin for each.  Else a bin ends where the rows up to it come
    closest to the next of ``max_bins - 1`` equal steps, as in Spark's forest, but of all rows.  Where a value
    takes several steps at once, the values after it end a bin each.
    Values are counted where they lie after a sort by range; only the counts of its partitions meet.
    """
    value = F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("f", "x")
    counted = rows.select(value).groupBy("f", "x").agg(F.count(F.lit(1)).alias("n"))
    part = F.shiftright("_at", 33)  # no two rows of a feature and partition are equal
    placed = shared(counted.orderBy("f", "x").withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", part)
    by_part, by_value = Window.partitionBy("f").orderBy("_part"), Window.partitionBy("f", "_part").orderBy("x")
    before, upto = (w.rowsBetween(Window.unboundedPreceding, end) for w, end in ((by_part, -1), (by_value, 0)))
    whole = Window.partitionBy("f")
    parts = placed.groupBy("f", "_part").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_kinds"), F.min("x").alias("_x"),
                                             F.min_by("n", "x").alias("_x_n"))
    parts = parts.select(
        "f", "_part", F.lead("_x").over(by_part).alias("_x"), F.lead("_x_n").over(by_part).alias("_x_n"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_kinds")],
        F.sum("_n").over(whole).alias("_rows"), F.sum("_kinds").over(whole).alias("_values"))
    ends = placed.join(parts, ["f", "_part"]).select(
        "f", "x", "_rows", "_values", F.coalesce(F.lead("x").over(by_value), "_x").alias("above"),
        (F.col("_kinds_before") + F.row_number().over(by_value)).alias("rank"),
        (F.col("_n_before") + F.sum("n").over(upto)).alias("_upto"), "n",
        F.coalesce(F.lead("n").over(by_value), "_x_n").alias("_next_n")).where(F.col("above").isNotNull())
    # steps that lie before the middle of a value's rows, twice the middle being a whole number
    steps = lambda twice: F.call_function("div", twice * max_bins + F.col("_rows") * 2 - 1, F.col("_rows") * 2)
    taken = steps(F.col("_upto") * 2 + F.col("_next_n")) - F.when(F.col("rank") == 1, 1).otherwise(steps(F.col("_upto") * 2 - F.col("n")))
    some = ends.select("f", "rank", "x", "above", F.when(F.col("_values") <= max_bins, 1).otherwise(taken).alias("steps"))
    wanted: dict[int, list[int]] = {}
    for f, rank, more in sorted(tuple(r) for r in some.where("steps > 0").select("f", "rank", "steps").collect()):
        for _ in range(more):  # each step its own end, after that of the step before
            ranks = wanted.setdefault(f, [])
            ranks.append(max(rank, ranks[-1] + 1) if ranks else rank)
    edges: list[list[tuple[float, float]]] = [[] for _ in features]
    chosen = F.lit(False)
    for f, ranks in wanted.items():
        chosen = chosen | (F.col("f") == f) & F.col("rank").isin(ranks)
    for f, x, above in sorted(tuple(r) for r in some.where(chosen).select("f", "x", "above").collect()):
        edges[f].append((x, above))
    return edges


def cells(rows: DataFrame, features: Sequence[str], label: str, moments: Sequence[tuple[float, float]],
          cuts: Sequence[Sequence[float]]) -> DataFrame:
    """(cell, label, rows) of all rows: a cell numbers the bins that the scaled features lie in, the first one foremost.

    ``moments`` are what is subtracted from each feature and what it is multiplied with then.
    """
    ends = [np.asarray(c, dtype=np.float64) for c in cuts]

    def number(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int64)
            for i, ((mean, factor), end) in enumerate(zip(moments, ends)):
                x = (batch.column(i).to_numpy(zero_copy_only=False) - mean) * factor
                cell = cell * (len(end) + 1) + np.searchsorted(end, x, side="left")  # a value at the end is below it
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(len(ends))], names=["cell", "y"])

    plain = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("y"))
    return plain.mapInArrow(number, "cell bigint, y double").groupBy("cell", "y").agg(F.count(F.lit(1)).alias("n"))


def _packed(a: np.ndarray) -> bytes:
    """Numbers as bytes of the narrowest type that holds them exactly; the first byte is its width."""
    if a.min(initial=0) >= 0 and a.max(initial=0) < 1 << 32 and np.array_equal(a, np.floor(a)):
        width = next(b for b in (1, 2, 4) if a.max(initial=0) < 1 << 8 * b)
        return bytes([width]) + a.astype(f"<u{width}").tobytes()
    return bytes([8]) + a.astype("<f8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f8" if raw[0] == 8 else f"<u{raw[0]}", offset=1)


def bagged(counted: DataFrame, trees: int, seed: int, space: int) -> DataFrame:
    """The bootstrap: for each tree and block of cells the cells drawn, their weights and the weighted sums of labels
    and squared labels (none if equal to the sums).  ``space`` is the number of possible cells."""
    blocks = -(-space >> BLOCK_BITS) or 1
    block = F.shiftright("cell", BLOCK_BITS)

    def draw(batches):
        held = [*batches]
        if not held:
            return
        cell, y, n = (pa.Table.from_batches(held).column(c).to_numpy() for c in ("cell", "y", "n"))
        order = np.lexsort((y, cell))
        for at in np.split(order, np.flatnonzero(np.diff(cell[order] >> BLOCK_BITS)) + 1):
            number = int(cell[at[0]]) >> BLOCK_BITS
            inside, value, count = cell[at] - (number << BLOCK_BITS), y[at], n[at]
            first = np.flatnonzero(np.diff(inside, prepend=-1))
            for some in batched(range(trees), TREES_A_BATCH):
                made = []
                for tree in some:
                    rng = np.random.Generator(np.random.PCG64([seed & (1 << 64) - 1, number, tree]))
                    drawn = rng.poisson(count).astype(np.float64)
                    weight, total, square = (np.add.reduceat(drawn * v, first) for v in (np.ones(1), value, value * value))
                    own = weight > 0
                    parts = (np.diff(inside[first][own], prepend=0), weight[own], total[own], square[own])
                    made.append((tree, number, *[_packed(p) for p in parts[:3]],
                                 b"" if np.array_equal(parts[2], parts[3]) else _packed(parts[3])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*made), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["tree", "block", "cells", "weights", "sums", "squares"])

    tasks = min(blocks, DRAW_TASKS)
    return counted.repartitionById(tasks, F.pmod(block, F.lit(tasks)).cast("int")).mapInArrow(draw, BAGS)


def _sums(at: np.ndarray, k: int, values: Sequence[np.ndarray], bins: np.ndarray | None = None, width: int = 1) -> list[np.ndarray]:
    """The sums of each of ``values`` by node, or by node and bin; by slices of the cells, of which wide copies are made."""
    out = [np.zeros(k * width) for _ in values]
    step = max(SLICE, 4 * k * width)
    for part in (slice(low, low + step) for low in range(0, len(at), step)):
        place = at[part].astype(np.int64)
        if bins is not None:
            place = place * width + bins[part]
        for o, v in zip(out, values):
            o += np.bincount(place, v[part], k * width)
    return [o.reshape(k, width) for o in out]


def grow(bins: np.ndarray, weight: np.ndarray, total: np.ndarray, squares: np.ndarray, cuts: Sequence[np.ndarray],
         max_depth: int) -> list[np.ndarray]:
    """One tree, level by level, as the columns of ``NODES`` from ``node`` on; children have higher numbers.

    ``bins`` has a row for each feature.  A node is split where the variance falls most, the first feature and
    lowest threshold of equal ones, if at all; every feature is tried at every node.
    """
    at = np.zeros(len(weight), dtype=np.int32)  # each cell's node among those of the level
    ids, made, levels = np.zeros(1, dtype=np.int64), 1, []
    for depth in range(max_depth + 1):
        k = len(ids)
        w, s, q = (v[:, 0] for v in _sums(at, k, (weight, total, squares)))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(w > 0, s / w, 0.0)
            impurity = np.where(w > 0, np.maximum(q / w - mean * mean, 0.0), 0.0)
        best, threshold = np.zeros(k), np.full(k, np.nan)
        feature, cut = np.full(k, -1, dtype=np.int16), np.zeros(k, dtype=np.int32)
        for f, ends in enumerate(cuts if depth < max_depth else ()):
            if not len(ends):
                continue
            lw, ls = (v[:, :-1].cumsum(axis=1) for v in _sums(at, k, (weight, total), bins[f], len(ends) + 1))
            rw, rs = w[:, None] - lw, s[:, None] - ls
            with np.errstate(divide="ignore", invalid="ignore"):
                low, high = ls / lw, rs / rw
                apart = (lw > 0) & (rw > 0) & (np.abs(low - high) > EQUAL * (np.abs(low) + np.abs(high)))
                gain = np.where(apart, (low - high) ** 2 * (lw / w[:, None]) * (rw / w[:, None]), 0.0)
            here = gain.argmax(axis=1)
            found = gain[np.arange(k), here]
            more = found > best
            best[more], feature[more], cut[more], threshold[more] = found[more], f, here[more], np.asarray(ends)[here[more]]
        split = feature >= 0
        child = (np.cumsum(split) * 2 - 2).astype(np.int32)  # the left child's place in the next level
        left = np.where(split, made + child, -1)
        levels.append((ids, feature, threshold, left, np.where(split, left + 1, -1), mean, impurity,
                       np.where(split, best, -1.0), w, s, q))
        if not split.any():
            break
        ids, made = made + np.arange(2 * split.sum()), made + 2 * int(split.sum())
        goes_on = split[at]
        at, bins, weight, total, squares = at[goes_on], bins[:, goes_on], weight[goes_on], total[goes_on], squares[goes_on]
        by, right = feature[at], np.zeros(len(at), dtype=np.int32)
        for f in range(len(cuts)):
            own = np.flatnonzero(by == f)
            right[own] = bins[f][own] > cut[at[own]]
        at = child[at] + right
    return [np.concatenate(c) for c in zip(*levels)]


def grown(bags: DataFrame, trees: int, cuts: Sequence[Sequence[float]], max_depth: int) -> DataFrame:
    """The nodes of all trees; each tree is grown by one task from its weighted cells."""
    ends = [np.asarray(c, dtype=np.float64) for c in cuts]

    def run(batches):
        held = [*batches]
        if not held:
            return
        held = pa.Table.from_batches(held)
        for tree in sorted(set(held.column("tree").to_pylist())):
            rows = held.filter(pa.compute.equal(held.column("tree"), tree)).sort_by("block").to_pylist()
            w, s, q = (np.concatenate([_unpacked(r[c] or r["sums"]) for r in rows]) for c in ("weights", "sums", "squares"))
            bins, done = np.empty((len(ends), len(w)), dtype=np.uint8 if max(map(len, ends)) < 256 else np.int32), 0
            for r in rows:
                cell = (r["block"] << BLOCK_BITS) + _unpacked(r["cells"]).astype(np.int64).cumsum()
                for f in reversed(range(len(ends))):
                    cell, bins[f, done:done + len(cell)] = np.divmod(cell, len(ends[f]) + 1)
                done += len(cell)
            nodes = grow(bins, w, s, q, ends, max_depth)
            kinds = [pa.int32()] * 2 + [pa.float64()] + [pa.int32()] * 2 + [pa.float64()] * 6
            names = [c.split()[0] for c in NODES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes[0]), tree, dtype=np.int32)), *[
                pa.array(c).cast(t) for c, t in zip(nodes, kinds)]], names=names)

    return bags.repartitionById(trees, "tree").mapInArrow(run, NODES)


def as_model(nodes: DataFrame, trees: int, features: int, params: dict) -> RandomForestRegressionModel:
    """The nodes as Spark's own model of a forest, by way of the files that such a model is saved as."""
    spark = nodes.sparkSession
    path = scratch_path(spark, f"grown-{uuid.uuid4().hex}")
    inner = F.col("feature") >= 0
    number = lambda c: F.col(c).cast("int")
    nodes.select(F.col("tree").alias("treeID"), F.struct(
        number("node").alias("id"), F.col("value").alias("prediction"), "impurity",
        F.array("weight", "total", "squares").alias("impurityStats"), F.col("weight").cast("bigint").alias("rawCount"), "gain",
        number("left").alias("leftChild"), number("right").alias("rightChild"),
        F.struct(number("feature").alias("featureIndex"),
                 F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData")).write.parquet(f"{path}/data")
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "defaultParamMap": {}}
    shown = {k: v for k, v in params.items() if k in ("featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "seed", "impurity")}
    kind = "org.apache.spark.ml.regression."
    each = [(t, json.dumps({**about, "class": f"{kind}DecisionTreeRegressionModel", "uid": f"risk_tree_{t}", "paramMap": shown}), 1.0)
            for t in range(trees)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = {**about, "class": f"{kind}RandomForestRegressionModel", "uid": "risk_forest", "paramMap": params,
             "numFeatures": features, "numTrees": trees}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestRegressionModel.load(path)


def fit_forest(rows: DataFrame, features: Sequence[str], label: str, moments: Sequence[tuple[float, float]], trees: int,
               seed: int, max_depth: int, max_bins: int, columns: dict[str, str]) -> RandomForestRegressionModel:
    """the forest of all ``rows``, which have every feature and the label, over the scaled features.

    ``columns`` names the model's columns (featuresCol, labelCol, predictionCol).
    """
    if trees < 1 or max_bins < 2 or max_depth < 0:
        raise ValueError("a forest needs a tree, two bins and a depth of 0 or more")
    if rows.isEmpty():
        raise ValueError("no row has every feature and the label")
    scaled = lambda i, x: (x - moments[i][0]) * moments[i][1]
    cuts = [[(scaled(i, low) + scaled(i, high)) / 2 for low, high in ends]
            for i, ends in enumerate(bin_edges(rows, features, max_bins))]
    space = 1
    for c in cuts:
        space *= len(c) + 1
    bags = bagged(cells(rows, features, label, moments, cuts), trees, seed, space)
    params = {**columns, "numTrees": trees, "maxDepth": max_depth, "maxBins": max_bins, "seed": seed,
              "impurity": "variance", "featureSubsetStrategy": "all"}
    return as_model(grown(bags, trees, cuts, max_depth), trees, len(features), params)
