import math

import numpy as np
import pytest

from shelfwise.llm import collisions as c

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, bound=0.9):
    ok = {}
    for k, (i, v, _) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[k] = x / np.linalg.norm(x)
    links = {k: [j for j in ok if j != k and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= bound] for k in ok}
    return links


def corpus(n=300, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n // 6):
        base = rng.standard_normal(dim)
        for s in (0, 0.02, 0.05, 0.3, 0.6, 0.0):
            v = base + s * rng.standard_normal(dim)
            rows.append((len(rows) * 3, [float(np.float32(x)) for x in v * rng.choice([1, 7])], 1))
    return rows


def components(rows, links):
    root = {k: rows[k][0] for k in range(len(rows))}
    while True:
        new = {k: min([root[k], *(root[j] for j in links.get(k, []))]) for k in root}
        if new == root:
            return root
        root = new


def test_against_brute_force(spark):
    rows = corpus() + [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 24, 1), (5003, [float("nan")] * 24, 1),
                       (5004, [1.0, None] * 12, 1), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 2),
                       (5007, [float("inf")] + [1.0] * 23, 0)]
    got = {r["vec_id"]: r for r in c.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    links = brute(rows)
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    true = sum(map(len, links.values()))
    assert 0.97 * true <= found <= true
    close = {k: [j for j in js if True] for k, js in links.items()}
    root = components(rows, close)
    same = sum(got[rows[k][0]]["component_id"] == root[k] for k in range(len(rows)))
    assert same >= 0.97 * len(rows)
    for i in (5000, 5001, 5002, 5003, 5004, 5007):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[5006]["component_id"] == 5005


def test_recall_with_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "CELL", 16)
    monkeypatch.setattr(c, "BLOCK", 8)
    rows = corpus(600, 32, 4)
    rows += [(9000 + k, [float(x) for x in np.float32(1 + 0.01 * np.random.default_rng(k).standard_normal(32))], 0)
             for k in range(40)]
    got = {r["vec_id"]: r["n_links"] for r in c.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    links = brute(rows)
    true = sum(map(len, links.values()))
    assert 0.95 * true <= sum(got.values()) <= true
    assert all(got[rows[k][0]] <= len(js) for k, js in links.items())


def test_repeated_rows_null_id_empty(spark):
    rows = [(4, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (2, [2.0, 0.1], 0), (None, [1.0, 0.0], 0), (7, [0.0, 1.0], 0)]
    got = sorted((tuple(r) for r in c.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(4, 3, 2, False), (4, 3, 2, False), (2, 3, 2, True), (None, 3, None, True), (7, 0, 7, True)], key=str)
    assert c.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_calibration():
    for n in (10, 10_000, 10_000_000):
        bits, tables, need = c.calibrate(n, 0.9)
        assert n / 2 ** bits <= c.CELL or bits == 0
        assert 1 < need <= c.PROJECTIONS and tables >= 1
    # bytes that a row is dealt with, per table its projections and keys: figures of the README
    assert [c.calibrate(n, 0.9)[1] for n in (51_282, 5_000_000, 10 ** 9)] == [10, 32, 97]


def test_counts_against_loops():
    rng = np.random.default_rng(8)
    q = rng.integers(0, c.MOST + 1, (20, 150)).astype(np.uint8)
    q[:, 70:] = np.clip(q[:, :80].astype(int) + rng.integers(-20, 21, (20, 80)), 0, c.MOST)
    for half, need in ((16, 12), (55, 15), (1, 2)):
        got = {(lo + i, lo + j) for lo, mask in c.passing(q, half, need) for i, j in zip(*np.nonzero(mask))}
        want = {(i, j) for i in range(150) for j in range(i + 1, 150)
                if sum(abs(int(x) - int(y)) <= half for x, y in zip(q[:, i], q[:, j])) >= need}
        assert got == want and want


@pytest.mark.parametrize("n", [800, 3000, 9000])
def test_recall_of_pairs_right_above_the_bound(spark, n):
    """Links planted at cosine 0.9 to 0.91; those a pair fails by chance are the calibrated few."""
    rng = np.random.default_rng(n)
    rows = []
    for k in range(n // 2):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        cos = rng.uniform(0.9002, 0.91)
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, (cos * x + math.sqrt(1 - cos ** 2) * y / np.linalg.norm(y)).tolist(), 0)]
    got = c.near_vectors(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).where("n_links > 0").count()
    assert got / n >= 0.96


def test_the_count_comes_before_vectors_and_drops_no_link(spark, monkeypatch):
    rows, written, cut = corpus(300), {}, c.cut
    monkeypatch.setattr(c, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    calls = []
    monkeypatch.setattr(c, "_linked", lambda df, bound, half, need, f=c._linked: (calls.append(need), f(df, bound, half, need))[1])
    c.near_vectors(spark.createDataFrame(rows, SCHEMA)).count()
    assert "v" not in written["asked"].columns and calls == [c.calibrate(written["classes"].count(), 0.9)[2]]
