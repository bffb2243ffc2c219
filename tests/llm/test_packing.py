import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers_llm import doc, frame, prose
from shelfwise.llm import packing as p


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def corpus():
    rows = [doc(k, prose(k, (k * 37) % 700)) for k in range(60)]
    return rows + [doc(100, None), doc(101, ""), doc(102, prose(1, 9000)), doc(103, "a  b  \n\n c\t'll <|endoftext|> 日本 🙂"),
                   doc(104, " x"), doc(104, " x"), doc(None, "null id")]


def check(got, rows, ids, length):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    want = []
    for i, text, *_ in rows:
        full = [*ids(text or ""), 0]
        for k, (start, n) in enumerate(p.cuts(len(full), length)):
            want.append((i, k, start, n, zlib.crc32(np.array(full[start:start + n], "<u4").tobytes())))
        assert sum(n for _, n in p.cuts(len(full), length)) == len(full)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    return len(by)


def test_pieces_and_places(spark, tokenizer):
    rows = corpus()
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for length, shard in ((2048, 1 << 20), (64, 2000)):
        parts = p.pieces(frame(spark, rows).select("doc_id", "text"), length)
        got = p.pack(parts, length, shard_tokens=shard).collect()
        made = check(got, rows, ids, length)
        least = -(-sum(r["length"] for r in got) // length)
        assert made <= least * 1.01 + 1


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 33, 400)
    seq, offset = p.place(lengths, 32)
    gaps = {}
    for n, s, o in zip(lengths.tolist(), seq.tolist(), offset.tolist()):
        def total(after):
            count = {}
            for g in after.values():
                if g:
                    count[g] = count.get(g, 0) + 1
            return sum(c * c for c in count.values())
        choices = {total({**gaps, k: g - n}) for k, g in gaps.items() if g >= n} or {total({**gaps, -1: 32 - n})}
        assert gaps.get(s, 32) == 32 - o
        gaps[s] = 32 - o - n
        assert total(gaps) == min(choices)


def test_shards_stay_bounded(spark, monkeypatch):
    rng, groups, packed = np.random.default_rng(1), [], p._packed

    def spied(rows, capacity):
        groups.extend(r["sum(length)"] for r in rows.groupBy("shard").sum("length").collect())
        return packed(rows, capacity)

    monkeypatch.setattr(p, "_packed", spied)
    for lengths, most in (([33 + k % 30 for k in range(3000)], 3000),  # no two fit together
                          ([35] * 1500 + [40 + k % 23 for k in range(1400)] + [3] * 100, 2900),
                          (rng.integers(1, 64, 3000).tolist(), 1600)):
        rows = [(k, 0, 0, n, k) for k, n in enumerate(lengths)]
        parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
        groups.clear()
        got = p.pack(parts, 64, shard_tokens=4000).collect()
        assert max(groups) <= 2 * 4000
        by = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in by.values():
            ends = np.cumsum([0] + [n for _, n in sorted(places)])
            assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 64
        assert sorted(r["doc_id"] for r in got) == list(range(len(lengths))) and len(by) <= most


def test_special_tokens_are_one_id(spark):
    (special, number), = p.special_tokens().items()
    docs = frame(spark, [doc(1, f"a {special}b"), doc(2, special * 3)])
    got = {r["doc_id"]: list(r["ids"]) for r in p.pieces(docs.select("doc_id", "text"), with_ids=True).collect()}
    assert got[1][1:3].count(number) == 1 and got[2] == [number] * 3 + [0]


def test_sequences_round_trip(spark, tokenizer):
    """Every document's tokens stand whole, piece by piece, in the sequences; null and repeated ids as well."""
    rows = [doc(k, prose(k, 30 + 9 * k)) for k in range(20)] + [doc(None, prose(77, 40)), doc(None, prose(78, 400)),
                                                              doc(None, None), doc(3, prose(3, 57)), doc(3, "another")]
    docs = frame(spark, rows)
    parts = {(r["ids_crc32"], r["length"]) for r in p.pieces(docs.select("doc_id", "text"), 256).collect()}
    found, seen = p.sequences(docs, 256).collect(), []
    for r in found:
        assert len(r["ids"]) <= 256
        at = 0
        for _ in r["doc_ids"]:  # the pieces lie end to end
            n = next(n for n in range(1, 257) if (zlib.crc32(np.array(r["ids"][at:at + n], "<u4").tobytes()), n) in parts)
            seen.append(tuple(r["ids"][at:at + n]))
            at += n
        assert at == len(r["ids"])
    want = []
    for _, text, *_ in rows:
        full = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want += [tuple(full[start:start + n]) for start, n in p.cuts(len(full), 256)]
    assert sorted(seen) == sorted(want)
    ids = [i for r in found for i in r["doc_ids"]]
    assert ids.count(None) == sum(len(p.cuts(len(tokenizer.encode(t or "").ids) + 1, 256)) for i, t, *_ in rows if i is None)


def test_columns_with_the_operators_names(spark):
    rows = [(k, prose(k, 20), 7, "x", 1.5) for k in range(5)]
    docs = frame(spark, rows, "doc_id long, text string, length int, sequence_id string, shard double")
    assert p.pack_documents(docs).count() == 5 and len(p.sequences(docs, 256).collect()) >= 1


def test_empty(spark):
    assert p.pack_documents(frame(spark, [])).collect() == []
