"""The forest's training: every row, exact bins, trees as a brute force grows them, no matter how the table lies."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from shelfwise import schema as S
from shelfwise.operators import forest
from shelfwise.operators import risk as R
from shelfwise.plans import catalog


def roots(model):
    return [t._java_obj.rootNode().impurityStats().count() for t in model.stages[-1].trees]


def rare_row(n):
    """One of the last 5000 rows, the last one of its product; a sample by hashes (``training_sample``) leaves it out."""
    return max(range(n - 5000, n), key=lambda i: hashlib.md5(f"42|{i % 5000}|2024-01-01|S|{i}".encode()).hexdigest())


def numbered(spark, n):
    """``n`` labelled rows with keys; stock 77 occurs once and alone has label 1."""
    rare = F.col("id") == rare_row(n)
    return spark.range(0, n, 1, 4).select(
        (F.col("id") % 5000).alias(S.PRODUCT), F.lit("2024-01-01").cast("date").alias(S.OBS_DATE), F.lit("S").alias(S.STORE),
        F.col("id").cast("decimal(38,0)").alias(S.ROW_SEQ), F.when(rare, 77.0).otherwise(F.pmod(F.hash("id"), F.lit(8)) * 20.0).alias(S.INV),
        *[F.lit(2.0).alias(c) for c in (S.SOLD, S.PRICE, S.DELIVERY)], rare.cast("int").alias(R.M.RISK))


def test_every_row_trains_the_forest(spark):
    """600,000 of these rows were drawn, and thresholds sought in 10,000 of those."""
    n = 640_000
    model = R.fit_risk_model(numbered(spark, n), trees=12, max_depth=3)
    drawn = roots(model)
    assert abs(sum(drawn) / 12 - n) < 5 * (n / 12) ** 0.5 and len(set(drawn)) > 1  # each row's weight is Poisson(1)
    cut = R.forest_table(model, spark).where(f"feature = '{S.INV}'").select("threshold").distinct().collect()
    mean, deviation = model.stages[1].mean[0], model.stages[1].std[0]
    assert {round(r[0] * deviation + mean, 6) for r in cut} <= {68.5, 78.5} and len(cut) == 2  # 60, 77 and 80


def test_every_row_counts_in_the_walked_scores(spark):
    """F2: the row that alone has label 1 was not in the sample, so its product scored 0."""
    n = 640_000
    got = {r[S.PRODUCT]: (r[R.SCORE], r.risk_level) for r in R.forest_scores(numbered(spark, n)).collect()}
    score, level = got.pop(rare_row(n) % 5000)
    assert 0.4 < score < 0.85 and level == ("High" if score > 0.7 else "Medium")  # 1 - 1/e of the trees have the row
    assert len(got) == 4999 and set(got.values()) == {(0.0, "Low")}


def test_every_row_counts_in_the_scores(spark):
    """as in the walked scores, by the model itself."""
    n = 640_000
    df = numbered(spark, n)
    got = {r[S.PRODUCT]: r[R.SCORE] for r in R.risk_scores(df, trees=30, max_depth=3).collect()}
    score = got.pop(rare_row(n) % 5000)
    assert 0.3 < score < 0.95 and set(got.values()) == {0.0} and len(got) == 4999
    model = R.fit_risk_model(df, trees=30, max_depth=3)  # the one that scored
    assert abs(sum(roots(model)) / 30 - n) < 5 * (n / 30) ** 0.5


def brute_edges(values, max_bins):
    """Spark's rule (``findSplitsForContinuousFeature``) over all values."""
    counts = sorted(Counter(values).items())
    if len(counts) <= max_bins:
        return [(a, b) for (a, _), (b, _) in zip(counts, counts[1:])]
    stride, upto, out = len(values) / max_bins, counts[0][1], []
    target = stride
    for (a, _), (b, n) in zip(counts, counts[1:]):
        before, upto = upto, upto + n
        if abs(before - target) < abs(upto - target):
            out.append((a, b))
            target += stride
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_bins_end_where_all_rows_say(spark, parts):
    rng = random.Random(3)
    n = 16 * 500
    columns = {"few": [float(rng.randrange(16)) for _ in range(n)], "many": [rng.gauss(0, 1) for _ in range(n)],
               "heavy": [0.0 if rng.random() < 0.6 else float(rng.randrange(300)) for _ in range(n)],
               "end": [9.0 if rng.random() < 0.4 else rng.random() for _ in range(n)], "one": [4.5] * n}
    rows = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(parts)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # values lie in several partitions
    try:
        got = forest.bin_edges(rows, list(columns), 16)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == [brute_edges(v, 16) for v in columns.values()]
    assert [len(e) for e in got][0] == 15 and got[4] == []


def brute_tree(rows, cuts, depth):
    """(feature, threshold, value, left, right) by trying every split on rows of (bins, weight, label)."""
    w, s = sum(r[1] for r in rows), sum(r[1] * r[2] for r in rows)
    best, pick = 1e-9, None
    for f, ends in enumerate(cuts if depth else ()):
        for c in range(len(ends)):
            sides = [r for r in rows if r[0][f] <= c], [r for r in rows if r[0][f] > c]
            if not all(sides):
                continue
            (lw, ls), (rw, rs) = ((sum(r[1] for r in x), sum(r[1] * r[2] for r in x)) for x in sides)
            gain = ls * ls / lw + rs * rs / rw - s * s / w
            if gain > best + 1e-9:
                best, pick = gain, (f, ends[c], sides)
    if not pick:
        return (-1, None, s / w)
    return (*pick[:2], s / w, *[brute_tree(x, cuts, depth - 1) for x in pick[2]])


def test_a_tree_is_as_brute_force_grows_it():
    rng = np.random.default_rng(5)
    cuts = [[0.5, 1.5, 2.5, 3.5], [], [0.5, 1.5], [10.0, 20.0, 30.0]]
    for label in (lambda n: rng.integers(0, 2, n).astype(float), lambda n: rng.normal(size=n).round(3) - 3, lambda n: np.full(n, 0.1)):
        bins = np.stack([rng.integers(0, len(c) + 1, 90) for c in cuts])
        weight, y = rng.integers(1, 4, 90).astype(float), label(90)
        node, feature, threshold, left, right, value, impurity, gain, w, s, q = forest.grow(bins, weight, weight * y, weight * y * y, cuts, 4)
        assert list(node) == list(range(len(node)))

        def tree(i):
            if feature[i] < 0:
                assert left[i] == right[i] == -1 and gain[i] == -1
                return (-1, None, pytest.approx(value[i]))
            assert w[i] == w[left[i]] + w[right[i]] and i < left[i] < right[i]
            fall = impurity[i] - sum(w[c] / w[i] * impurity[c] for c in (left[i], right[i]))
            assert gain[i] == pytest.approx(fall, abs=1e-9)
            return (feature[i], threshold[i], pytest.approx(value[i]), tree(left[i]), tree(right[i]))

        assert brute_tree([(bins[:, k], weight[k], y[k]) for k in range(90)], cuts, 4) == tree(0)


def test_slices_make_no_difference(monkeypatch):
    rng = np.random.default_rng(6)
    cuts = [[0.5], [0.5, 1.5, 2.5]]
    bins, weight, total = np.stack([rng.integers(0, len(c) + 1, 500) for c in cuts]), np.ones(500), rng.integers(0, 2, 500).astype(float)
    whole = forest.grow(bins, weight, total, total, cuts, 5)
    monkeypatch.setattr(forest, "SLICE", 1)
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(whole, forest.grow(bins, weight, total, total, cuts, 5)))


def test_numbers_are_packed_exactly():
    for a in ([], [0], [255, 0], [256], [65536, 3], [2 ** 32], [-1], [0.5, 3], [2 ** 40 + 0.5]):
        a = np.array(a, dtype=np.float64)
        assert np.array_equal(forest._unpacked(forest._packed(a)), a)


def test_cells_hold_every_row(spark):
    values = [(float(k % 3), float(k % 2), 0.25 * (k % 4)) for k in range(600)] + [(1.0, 0.0, -0.5)] * 7
    rows = spark.createDataFrame(values, "a double, b double, y double").repartition(5)
    moments = [(1.0, 2.0), (0.0, 0.0)]  # the second feature has no deviation
    cuts = [[-1.0, 1.0], []]
    got = {(r.cell, r.y): r.n for r in forest.cells(rows, ["a", "b"], "y", moments, cuts).collect()}
    assert got == Counter((int(a), y) for a, _, y in values)
    bags = forest.bagged(forest.cells(rows, ["a", "b"], "y", moments, cuts), 40, 1, 3).collect()
    assert len(bags) == 40 and all(r.block == 0 for r in bags)
    weight = [forest._unpacked(r.weights).sum() for r in bags]
    assert abs(sum(weight) / 40 - 607) < 5 * (607 / 40) ** 0.5
    assert all(r.squares and len(forest._unpacked(r.sums)) == len(forest._unpacked(r.cells)) <= 3 for r in bags)


def test_the_layout_does_not_change_a_node(spark):
    df = catalog.enriched(spark, sf_dir("0.001")).cache()
    columns = ("tree", "node", "feature", "threshold", "left", "right", "value")
    got = [sorted(tuple(r) for r in R.forest_table(R.fit_risk_model(d, trees=4, max_depth=7, reuse=False), spark).select(*columns).collect())
           for d in (df.coalesce(1), df.repartition(13))]
    assert got[0] == got[1] and {r[0] for r in got[0]} == {0, 1, 2, 3}
    df.unpersist()


def test_a_table_without_labelled_rows_is_refused(spark):
    with pytest.raises(ValueError):
        R.fit_risk_model(numbered(spark, 5000).where(f"{S.INV} < 0"), trees=2)
