import random

import numpy as np
import pyarrow as pa

from helpers_llm import by_id, doc, frame
from shelfwise.llm import common, count_viterbi, level_dedup, setsketch
from shelfwise.llm.text import scan


def brute(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {x: top(x) for x in root}


def components(spark, edges, kind="long"):
    rows = common.components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    n = 10_000
    path = [(k, k + 1) for k in range(n)]
    names, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, name: (names.append(name), cut(df, name))[1])
    assert set(components(spark, path).values()) == {0}
    assert names.count("hop") < 30


def test_components_of_mixed_graphs(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(1000, 1100)] + [(5000, 4000 + k) for k in range(300)] + [(7, 7)] * 3 + [(8, 9), (9, 8)]
    edges += [(10_000 + rng.randrange(400), 10_000 + rng.randrange(400)) for _ in range(250)]
    want = brute([e for e in edges if e[0] != e[1]])
    assert components(spark, edges) == want
    assert components(spark, [(f"n{a}", f"n{b}") for a, b in edges[:150]], "string").keys() == \
        {f"n{x}" for e in edges[:150] for x in e}
    assert components(spark, [(1, 1)]) == {}


def words_of(texts):
    return next(scan(pa.array([" ".join(texts)])))


def alternating(n):
    """The Thue-Morse word of 2**n letters and its complement: equal under any polynomial modulo 2**64."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_unlike_words_have_unlike_hashes():
    rng = random.Random(1)
    texts = [w for n in range(12) for w in alternating(n)]
    texts += ["".join(rng.choice("abcé中") for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]
    texts += ["a" * n for n in range(1, 300)] + ["x" * 8 + c * k for c in "\x00yz" for k in range(1, 9)]
    texts = list(dict.fromkeys(texts))
    for hashes in words_of(texts).hashes():
        assert len(np.unique(hashes)) == len(texts)
    w = next(scan(pa.array(["ABC abc AbcdefghijK", None, "", "abc"]), fold=True))
    a, b = w.hashes()
    assert a[0] == a[1] == a[3] and b[0] == b[3] and len({*a.tolist()}) == 2


def test_a_word_has_its_hash_wherever_it_stands():
    texts = ["abcdefgh", "x abcdefgh", "abcdefgh yy", "q abcdefghi abcdefgh"]
    found = [dict(zip(t.split(), zip(*(h.tolist() for h in next(scan(pa.array([t]))).hashes())))) for t in texts]
    assert len({f["abcdefgh"] for f in found}) == 1


def test_operators_tell_alternating_words_apart(spark):
    one, two = alternating(10)
    docs = frame(spark, [doc(1, one), doc(2, two)])
    assert {i: (r["component_id"], r["kept"]) for i, r in by_id(setsketch.near_dedup(docs)).items()} == {1: (1, True), 2: (2, True)}
    filler = " ".join(f"w{k}" for k in range(61))
    docs = frame(spark, [doc(1, f"{filler[:90]} {one} {filler[90:]}"), doc(2, f"{filler[:90]} {two} {filler[90:]}")])
    got = by_id(level_dedup.substring_dedup(docs))
    assert got[2]["n_removed"] == 0
    vocab = [(p, -1.0) for p in ("▁", "a", "b", "ab")]
    counts = by_id(count_viterbi.token_counts(frame(spark, [doc(1, one), doc(2, two)]), vocab))
    assert counts[1]["n_tokens"] != counts[2]["n_tokens"] or one.count("ab") == two.count("ab")
