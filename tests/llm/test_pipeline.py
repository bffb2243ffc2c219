import zlib

import corpus_pipeline as c
import numpy as np
from helpers_llm import doc, frame, prose, words
from shelfwise.llm import common, quality_rules


def small():
    base, passage = prose(1, 300), prose(50, 90)
    rows = [doc(k, prose(100 + k, 200), source=f"s{k % 4}") for k in range(30)]
    rows += [doc(100, base), doc(101, base), doc(102, base.replace(base.split()[7], "other", 1)),
             doc(103, prose(60, 80) + " " + passage, source="s1"), doc(104, passage + "\n" + prose(61, 80), source="s2"),
             doc(105, None), doc(106, ""), doc(107, "few words"), doc(108, "again " * 80), doc(100, base),
             doc(109, prose(70, 4000), source=None)]
    return rows


def whole_texts(rows):
    """The texts of the documents in the sequences; repeated ones may take each other's equal pieces."""
    from shelfwise.llm import packing
    coder, out, open_ = packing.encoder(packing.vocabulary()), [], {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = (open_[r["doc_id"], r["start"]].pop() if r["start"] else []) + r["ids"]
        if ids[-1] == packing.CLOSING:
            out.append(coder.decode(ids[:-1]))
        else:
            open_.setdefault((r["doc_id"], len(ids)), []).append(ids)
    return out


def test_stages(spark):
    docs, seen = frame(spark, small()), []
    for name, stage in c.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        seen.append({r["doc_id"] for r in rows})
        if name != "packing":
            assert out.columns == list(c.COLUMNS)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "quality_rules":
            assert not seen[0] & {105, 106, 107, 108} and {100, 101, 102, 103, 104, 109} <= seen[0]
        if name == "near_dedup":
            assert 100 in seen[1] and not seen[1] & {101, 102} and len(rows) == len(seen[1])
        if name == "substring_dedup":
            text = {r["doc_id"]: r["text"] for r in rows}
            assert text[104] == prose(61, 80) and text[103].endswith(prose(50, 90))
            before = sum(len(words(r["text"])) for r in rows)
        if name == "mixing":
            assert abs(sum(len(words(r["text"])) for r in rows) - before) <= 200
            mixed = [r["text"] for r in rows]
        if name == "packing":
            assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and len(rows) >= len(mixed)
            assert all(r["length"] == len(r["ids"]) for r in rows)
            assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
            # the tokens of all sequences are those of the texts that the mix made
            assert sorted(whole_texts(rows)) == sorted(mixed)
        docs = spark.createDataFrame(rows, out.schema)


def test_rejected_are_those_of_the_rules(spark):
    docs = frame(spark, small())
    kept = {r["doc_id"] for r in c.quality(spark, docs, "").collect()}
    led = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
    assert kept == {r["doc_id"] for r in led if r["kept"]}


def test_rows_that_share_an_id(spark):
    a, b, d, passage = prose(201, 200), prose(202, 200), prose(203, 200), prose(204, 90)
    near = lambda t: t.replace(t.split()[7], "other", 1)
    rows = [doc(1, a), doc(1, b), doc(1, a), doc(2, near(a)), doc(3, d), doc(3, near(b)), doc(0, d[:90]), doc(None, a)]
    got = c.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted(
        [("1", a), ("1", b), ("3", d), ("0", d[:90]), ("None", a)])
    x, y = prose(205, 80), prose(206, 80)
    rows = [doc(4, f"{d} {passage}")] + [doc(5, f"{passage} {x}")] * 3 \
        + [doc(5, f"{y} {passage}"), doc(5, f"{passage}\n{x}  end"), doc(5, b)]
    got = c.substring_dedup(spark, frame(spark, rows), "").collect()
    assert sorted(r["text"] for r in got) == sorted([f"{d} {passage}", x, x, x, y, f"{x}  end", b])


def test_empty_and_extra_columns(spark):
    docs = frame(spark, [])
    for _, stage in c.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
        docs = spark.createDataFrame([], docs.schema)
    extra = frame(spark, small()[:5]).selectExpr("*", "1 as size", "2 as failed", "'x' as kept", "3 as id")
    for name, stage in c.STAGES[:4]:
        assert stage(spark, extra, "").columns == list(c.COLUMNS)


def test_run(spark):
    before = list(common._WRITTEN)
    out = c.run(spark, "/root/testdata/sf0.001")
    assert common._WRITTEN[:len(before)] == before and len(common._WRITTEN) == len(before) + 1
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_a_stage_frees_what_the_stage_before_left(spark):
    stages = dict(c.STAGES)
    docs = frame(spark, small())
    first = stages["near_dedup"](spark, docs, "")
    left = c._LEFT[1]
    assert left and set(left) <= set(common._WRITTEN)
    lazy = stages["substring_dedup"](spark, first, "")  # reads them: nothing goes
    assert set(left) <= set(common._WRITTEN) and lazy.count() > 0
    again = common.cut(stages["near_dedup"](spark, docs, ""), "reread")
    left = c._LEFT[1]
    stages["substring_dedup"](spark, again, "").collect()
    assert not set(left) & set(common._WRITTEN) and again.count() > 0
