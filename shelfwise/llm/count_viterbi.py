"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton finds every vocabulary piece in the distinct words of
a run of texts; dynamic programming over the places of a word carries the best
score and the number of pieces on its path, so no segmentation is built.  All
words advance together, one place at a time.  The rules are those of the public
unigram tokenizers, the order of floating-point sums included:

* a word is encoded by itself, behind the mark U+2581;
* at a place the path with the larger score wins, and of equal scores the one
  whose last piece begins first;
* a character that is no piece is unknown: its score is the smallest piece score
  less 10, and unknown neighbours fuse into one token.

The vocabulary is a parameter.  The default takes the pieces of the public
32k vocabulary in their order and gives them Zipf's law as probabilities, since
no unigram model is at hand and none is to be trained.

Edge cases: a null, empty or blank text has no tokens; a word of any length is
one dynamic program; repeated rows get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import table
from shelfwise.llm.text import scan

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: distinct words whose counts a task remembers before it starts anew
REMEMBERED = 1 << 20


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, log probability) of the pieces of a public model, by Zipf's law on their order."""
    import public_tokenizers
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    # a mark stands at the beginning of a word only
    pieces = [p for p in dict.fromkeys(pieces) if p and "\n" not in p and MARK not in p[1:]]
    total = sum(1 / r for r in range(1, len(pieces) + 1))
    return [(p, -math.log(r * total)) for r, p in enumerate(pieces, 1)]


class Counter:
    """Counts the pieces of words under one vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for i, (piece, _) in enumerate(vocab):
            self.automaton.add_word(piece, i)
        if vocab:
            self.automaton.make_automaton()
        self.empty = not vocab
        self.length = np.array([len(p) for p, _ in vocab], np.int64)
        self.score = np.array([s for _, s in vocab], np.float64)
        self.unknown = (self.score.min() if len(vocab) else 0.0) - UNKNOWN_PENALTY
        self.seen: dict[tuple[int, int], tuple[int, int]] = {}  # by both hashes of a word

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, unknown pieces) of each word."""
        text = "\n".join(MARK + w for w in words)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        last = begin + lengths
        if self.empty:
            found = np.empty((0, 2), np.int64)
        else:
            found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        # matches come by end and, of one end, the longest (that begins first) first
        end, piece = found[:, 0] + 1, found[:, 1]
        start, gain = end - self.length[piece], self.score[piece]
        places = int(last[-1])
        word = np.repeat(np.arange(len(words)), lengths + 1)[:places]
        known = np.zeros(places + 1, bool)
        known[start[end - start == 1]] = True
        inside = np.ones(places, bool)
        inside[last[:-1]] = False  # the separators
        unknown = np.flatnonzero(inside & ~known[:places]) + 1  # where an unknown character ends
        step, unknown_step = end - begin[word[end - 1]], unknown - begin[word[unknown - 1]]
        kind = np.uint16 if lengths.max() < 1 << 16 else np.int64  # short keys are sorted by radix
        order = np.argsort(step.astype(kind), kind="stable")
        end, start, gain, step = end[order], start[order], gain[order], step[order]
        order = np.argsort(unknown_step.astype(kind), kind="stable")
        unknown, unknown_step = unknown[order], unknown_step[order]
        at = np.searchsorted(step, np.arange(1, lengths.max() + 2))
        unknown_at = np.searchsorted(unknown_step, np.arange(1, lengths.max() + 2))
        best = np.full(places + 1, -np.inf)
        best[begin] = 0
        pieces, unknowns, tail = np.zeros(places + 1, np.int64), np.zeros(places + 1, np.int64), np.zeros(places + 1, bool)
        for k in range(int(lengths.max())):
            a, b = at[k], at[k + 1]
            if b > a:
                e, s = end[a:b], start[a:b]
                score = best[s] + gain[a:b]
                new = np.ones(b - a, bool)
                new[1:] = e[1:] != e[:-1]
                heads = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                top = np.flatnonzero(score == np.maximum.reduceat(score, heads)[group])
                first = np.ones(len(top), bool)
                first[1:] = group[top[1:]] != group[top[:-1]]
                top = top[first]
                best[e[top]], pieces[e[top]], unknowns[e[top]] = score[top], pieces[s[top]] + 1, unknowns[s[top]]
            a, b = unknown_at[k], unknown_at[k + 1]
            if b > a:
                e = unknown[a:b]
                score = best[e - 1] + self.unknown
                better = score > best[e]
                e = e[better]
                fresh = ~tail[e - 1]
                best[e], pieces[e], unknowns[e] = score[better], pieces[e - 1] + fresh, unknowns[e - 1] + fresh
                tail[e] = True
        return pieces[last], unknowns[last]

    def of(self, w) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, unknown pieces) of every word of a run of texts."""
        one, two = w.hashes()
        keys, first, which = np.unique(one, return_index=True, return_inverse=True)
        if not (two[first][which] == two).all():  # words that differ share the first hash
            keys, first, which = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
            which = which.reshape(-1)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        hashes = list(zip(one[first].tolist(), two[first].tolist()))
        fresh = [i for i, h in enumerate(hashes) if h not in self.seen]
        if fresh:
            raw = w.data.tobytes()
            words = [raw[s:e].decode("utf-8", "replace") for s, e in
                     zip(w.starts[first[fresh]].tolist(), w.ends[first[fresh]].tolist())]
            pieces, unknowns = self.count(words)
            self.seen.update(zip([hashes[i] for i in fresh], zip(pieces.tolist(), unknowns.tolist())))
        per = np.array([self.seen[h] for h in hashes], np.int64).reshape(-1, 2)
        return per[which, 0], per[which, 1]


def token_counts(docs: DataFrame, vocab: list[tuple[str, float]] | None = None, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens and n_unknown."""
    vocab = vocabulary() if vocab is None else vocab
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # a vocabulary, of fixed size
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_unknown", T.LongType())])

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            for w in scan(batch.column(1)):
                sums = [np.diff(w.at)]
                for per in counter.of(w) if len(w.starts) else (np.zeros(0, np.int64),) * 2:
                    total = np.concatenate([[0], np.cumsum(per)])
                    sums.append(total[w.at[1:]] - total[w.at[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.n_texts), *[pa.array(s.astype(np.int64)) for s in sums]],
                    names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
