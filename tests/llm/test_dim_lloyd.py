import hashlib
import math

import numpy as np
import pytest

from shelfwise.llm import dim_lloyd as d

SCHEMA = "vec_id long, embedding array<double>, cluster int, chunk string"


def brute(rows, clusters=40, rounds=5, dim=64):
    """Lloyd's rounds with Python integers."""
    own = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
           if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in own if i is not None)
    cents = [q for _, q in start[:clusters]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        found = [nearest(q)[1] for _, q in own]
        for k in range(len(cents)):
            members = [q for (_, q), c in zip(own, found) if c == k]
            if members:
                cents[k] = [sum(column) // len(members) for column in zip(*members)]
    last = [nearest(q) for _, q in own]
    return sorted(((i, k, dist) for (i, _), (dist, k) in zip(own, last)), key=str), cents


def found(frames):
    rows, slices = frames
    cents = {}
    for r in slices.orderBy("cluster", "block").collect():
        cents[r["cluster"]] = cents.get(r["cluster"], []) + r["slice"]
    return sorted(map(tuple, rows.select("vec_id", "cluster", "distance").collect()), key=str), [cents[k] for k in sorted(cents)]


def blobs(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, dim))
    return [(int(i) * 3, [float(x) for x in centres[i % 7] + spread * rng.standard_normal(dim)], 1, "x") for i in range(n)]


@pytest.mark.parametrize("width", [5, 16, 100])
def test_against_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(d, "ROWS", 16)
    rows = blobs(150, 16, width)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(d.cluster(df, clusters=12, rounds=4, dim=16, width=width)) == brute(rows, 12, 4, 16)


def test_odd_rows_ties_and_repeated_rows(spark):
    one = [1.0, -0.001, 2.0, 0.0]
    rows = [(5, one, 0, "x"), (5, one, 0, "x"), (5, [x + 1 for x in one], 0, "x"), (None, [9.0] * 4, 0, "x"),
            (6, [-x for x in one], 0, "x"), (7, [1e-9, -1e-9, 0.5, 0.25], 0, "x"), (8, [3.0] * 4, 0, "x"), (9, [3.0] * 4, 0, "x")]
    bad = [(10, None, 0, "x"), (11, [], 0, "x"), (12, [1.0] * 5, 0, "x"), (13, [1.0, None, 1.0, 1.0], 0, "x"),
           (14, [float("nan")] * 4, 0, "x"), (15, [float("inf"), 1.0, 1.0, 1.0], 0, "x")]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    for clusters in (3, 40):
        assert found(d.cluster(df, clusters=clusters, dim=4, width=3)) == brute(rows, clusters, 5, 4)


def test_huge_components_are_held(spark):
    rows = [(i, [1e30 * (-1) ** i, 400000.0 + i], 0, "x") for i in range(6)]
    got, cents = found(d.cluster(spark.createDataFrame(rows, SCHEMA), clusters=2, dim=2))
    assert len(got) == 6 and all(0 <= r[2] < 2 ** 63 for r in got)
    held = [(i, [max(-d.BOUND, min(d.BOUND, x)) for x in v]) for i, v, *_ in rows]
    assert (got, cents) == brute(held, 2, 5, 2)


def test_partial_distances_are_exact():
    rng = np.random.default_rng(3)
    for top in (1 << 10, 1 << 27):
        x, c = rng.integers(-top, top + 1, (9, 64)), rng.integers(-top, top + 1, (4, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
        assert d.partial(x, c).tolist() == want


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert found(d.cluster(empty)) == ([], [])
    empty.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert d.op13_centroids(spark, str(tmp_path)).collect() == []
