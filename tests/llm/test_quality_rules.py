import os

import duckdb
import pytest

from helpers_llm import doc, frame, prose, words
from shelfwise.llm import quality_rules as q

EDGE = [doc(1, None), doc(2, ""), doc(3, " \t\n\x0b"), doc(4, "a b c a b c"), doc(5, "x\n\nx\ny\nx"),
        doc(6, "#a *b$ %c&|<>"), doc(6, "#a *b$ %c&|<>"), doc(None, prose(1, 60)), doc(8, prose(2, 30000, 50)),
        doc(9, "é" * 5 + "  ß " + "日本 語"), doc(10, "a a a a"), doc(11, "a a"), doc(12, "word " * 60)]


def brute(text):
    w, t = words(text), text or ""
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(3))
    lines = [x for x in t.split("\n") if words(x)]
    n = len(w)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


def test_measures_against_brute_force(spark):
    rows = q.ledger(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert {k: r[k] for k in q.MEASURES} == brute(r["text"]), r["doc_id"]


def test_policies_and_ablation(spark):
    rows = q.ledger(frame(spark, EDGE)).cache()
    base = {r["doc_id"]: r["kept"] for r in q.apply_policy(rows, "v1-base").collect()}
    assert base[None] and not base[1] and not base[12]
    table = {r["rule"]: r for r in q.ablation(rows, "v2").collect()}
    mask = q.POLICIES["v2"]
    bits = [r["failed"] & mask for r in rows.collect()]
    for rule, bit in q.BIT.items():
        assert table[rule]["failing"] == sum(b & bit != 0 for b in bits)
        assert table[rule]["failing_alone"] == sum(b == bit for b in bits)
        assert table[rule]["rejected_without"] == sum(b & ~bit != 0 for b in bits)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", 7, "z")], "doc_id long, text string, n_words int, failed string")
    row = q.ledger(df).collect()[0]
    assert row["n_words"] == 2 and row["failed"] & q.BIT["few_words"]
    assert q.ledger(frame(spark, [])).collect() == []
    assert {r["failing"] for r in q.ablation(q.ledger(frame(spark, []))).collect()} <= {0, None}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_oracle(spark, sf):
    path = f"/root/testdata/{sf}"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{os.path.join(path, 'documents.parquet')}'")
    got = sorted(tuple(r) for r in q.op5_quality_rules(spark, path).collect())
    names = q.op5_quality_rules(spark, path).columns
    want = db.execute(f"select {', '.join(names)} from ({q.ORACLE_SQL['op5_quality_rules']}) order by all").fetchall()
    assert got == sorted(want)


def test_native_plan(spark):
    plan = q.apply_policy(q.ledger(frame(spark, EDGE)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowConverters", "")
