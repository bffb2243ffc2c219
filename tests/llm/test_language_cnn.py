import math
import random
import zlib

import numpy as np
from helpers_llm import doc, frame
from shelfwise.llm import language_cnn as n

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = n.op10_language(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = n.train(docs, per_label=60)
    long_ = docs.where("lang = 'de'").limit(40).agg({"text": "max"}).first()[0] * 400
    rows = [doc(1, None), doc(2, ""), doc(3, "12 34 !?"), doc(4, "das und die der ist nicht über"), doc(5, long_), doc(5, long_),
            doc(None, "the of and to")]
    got = n.identify(frame(spark, rows), net).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[5]["lang_pred"] == "de" and by[None]["lang_pred"] in net.labels
    assert n.identify(frame(spark, []), net).collect() == []
    assert {r["lang_pred"] for r in n.identify(frame(spark, rows), None).collect()} == {"und"}
    assert n.train(frame(spark, [doc(1, "x", lang=None), doc(2, None)])) is None


def test_training_ignores_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = n.train(docs, per_label=20), n.train(docs.repartition(5), per_label=20)
    assert a.labels == b.labels and all((a.p[k] == b.p[k]).all() for k in a.p)


def by_loops(net, raw):
    """The network's probabilities for one text: byte by byte, filter by filter, window by window."""
    p, total, n_labels = net.p, 0.0, len(net.labels)
    out = [0.0] * n_labels
    for lo in range(0, len(raw), n.WINDOW):
        part = raw[lo:lo + n.WINDOW]
        window = part + b"\0" * (n.WINDOW - len(part) + max(n.WIDTHS) - 1)
        pooled = []
        for f in range(n.FILTERS * len(n.WIDTHS)):
            width = n.WIDTHS[f // n.FILTERS]
            best = max(sum(float(p["e"][window[i + k]][d]) * float(p["w"][k * n.EMBED + d][f])
                           for k in range(width) for d in range(n.EMBED)) for i in range(n.WINDOW))
            pooled.append(max(0.0, best + float(p["b"][f])))
        z = [sum(h * float(p["u"][f][j]) for f, h in enumerate(pooled)) + float(p["c"][j]) for j in range(n_labels)]
        e = [math.exp(x - max(z)) for x in z]
        for j in range(n_labels):
            out[j] += len(part) * e[j] / sum(e)
        total += len(part)
    return [x / total for x in out]


def test_forward_pass_by_loops(spark):
    net = n.Network(["de", "en", "fr"])
    net.p["c"] = np.array([0.1, -0.2, 0.3], np.float32)
    net.p["b"] = np.linspace(-1, 1, len(net.p["b"])).astype(np.float32)
    rng = random.Random(5)
    texts = ["a", "kurz und gut", "é" * 200, "".join(rng.choice("abcdef ghi\n") for _ in range(700))]
    extra = frame(spark, [doc(k, t) for k, t in enumerate(texts)]).selectExpr("*", "1 as letter", "'x' as lang_pred", "2 as score")
    got = {r["doc_id"]: r for r in n.identify(extra, net).collect()}
    for k, t in enumerate(texts):
        want = by_loops(net, t.encode())
        assert abs(got[k]["score"] - max(want)) < 1e-4
        assert got[k]["lang_pred"] == net.labels[want.index(max(want))]


def test_rows_without_an_id_are_not_held_out(spark):
    rows = frame(spark, [doc(None, "x"), doc(1, "x"), doc(3, "x")])
    got = {r["doc_id"]: r["h"] for r in rows.select("doc_id", n.held_out().alias("h")).collect()}
    assert got == {None: False, **{i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 3)}}
