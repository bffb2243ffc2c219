import random

from helpers_llm import doc, frame, prose, words
from tokenizers import Tokenizer, models

from shelfwise.llm import count_viterbi as v


def reference(vocab):
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in vocab))] + vocab, unk_id=0))
    return lambda w: t.encode(v.MARK + w, add_special_tokens=False).ids


def test_words_against_the_public_tokenizer():
    vocab = v.vocabulary()
    ref, counter, rng = reference(vocab), v.Counter(vocab), random.Random(1)
    some = ["a", "the", "日本語", "🙂🙂x🙂", "▁▁x", "x" * 300, "̀́", "naïve-ÿ", "''", " ", "ab\x00c"]
    some += ["".join(rng.choice("abcdeéß日ሴ- zq") for _ in range(rng.randrange(1, 30))).replace(" ", "") or "q" for _ in range(500)]
    n, u = counter.count(some)
    for w, a, b in zip(some, n, u):
        ids = ref(w)
        assert (a, b) == (len(ids), ids.count(0)), w


def test_ties():
    vocab = [(v.MARK, -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), (v.MARK + "a", -2.0), ("ba", -2.0)]
    ref, counter = reference(vocab), v.Counter(vocab)
    some = ["a", "ab", "aba", "abab", "babab", "xaxxb", "xx", "abx"]
    n, _ = counter.count(some)
    assert n.tolist() == [len(ref(w)) for w in some]


def test_documents(spark):
    vocab = v.vocabulary()
    ref = reference(vocab)
    rows = [doc(1, None), doc(2, ""), doc(3, " \n\t"), doc(4, "Hello  wörld\n日本"), doc(4, "Hello  wörld\n日本"),
            doc(5, prose(1, 20000)), doc(None, "x"), doc(6, "y" * 100000)]
    got = v.token_counts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        found = [ref(w) for w in words(text[r["doc_id"]])]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (
            len(found), sum(map(len, found)), sum(x.count(0) for x in found))
    assert v.token_counts(frame(spark, [])).collect() == []
