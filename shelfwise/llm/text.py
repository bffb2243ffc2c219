"""Words, word hashes and window hashes of Arrow text columns, with numpy.

A word has two 64-bit hashes.  Its bytes are taken eight at a time: a word of up to
eight bytes is one number, and both hashes are bijections of it and the length, so no
two such words share either; one of up to sixteen bytes is two numbers, mixed in
different order; longer ones, which are rare, go through BLAKE2b.  None of it is linear
in the bytes, so no regular pattern of letters makes two words equal.

A word is a maximal run of bytes other than space and ``\\t``..``\\r``, which is
``[^\\x20\\x09-\\x0D]+`` on UTF-8.  Texts are scanned as whole byte buffers, a few
hundred kilobytes at a time, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
#: the low bytes of a little-endian number, by how many of them a word has
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH = np.uint64(0xA24BAED4963EE407)
_OTHER = np.uint64(0x9FB21C651E98DF25)
_MULT = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xD1342543DE82EF95)}
_INV = {k: np.uint64(pow(int(v), -1, 1 << 64)) for k, v in _MULT.items()}
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, kind: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get((kind, inverse))
    if have is None or len(have) < n:
        base = (_INV if inverse else _MULT)[kind]
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _POWERS[kind, inverse] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


class Words:
    """The words of a run of consecutive texts."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray, fold: bool = False):
        self.first, self.data, self.bounds = first, data, bounds
        self.n_texts = len(bounds) - 1
        n = len(data)
        solid = ~_SPACE[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        at = bounds[:-1][bounds[:-1] < n]
        begin[at] = solid[at]
        at = bounds[1:][bounds[1:] > 0] - 1
        end[at] = solid[at]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        #: word numbers at which each text begins; one more than the texts
        self.at = np.searchsorted(self.starts, bounds)
        self._fold = _LOWER if fold else _SAME

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word's bytes."""
        n = self.ends - self.starts
        data = np.zeros(len(self.data) + 16, np.uint8)
        data[:len(self.data)] = self._fold[self.data]
        at_byte = np.ndarray(len(self.data) + 9, "<u8", buffer=data, strides=(1,))  # the eight bytes from each place
        one = at_byte[self.starts] & _LOW[np.minimum(n, 8)]
        one += n.astype(np.uint64) * _LENGTH
        first, second = mix(one), mix(one ^ _OTHER)
        two = np.flatnonzero(n > 8)
        if len(two):
            rest = mix(at_byte[self.starts[two] + 8] & _LOW[np.minimum(n[two] - 8, 8)] ^ _LENGTH)
            first[two] = mix(first[two] + rest)
            second[two] = mix(rest * _OTHER ^ second[two])
        for i in np.flatnonzero(n > 16).tolist():
            digest = hashlib.blake2b(data[self.starts[i]:self.ends[i]], digest_size=16).digest()
            first[i], second[i] = np.frombuffer(digest, "<u8")
        return first, second

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def window_hashes(h: np.ndarray, length: int, kind: int = 1) -> np.ndarray:
    """A 64-bit hash of each ``length`` consecutive words (of one text or across), given their hashes.

    Both kinds, each of its own hashes of the words, are one hash of 128 bits.
    """
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h), kind, False), out=run[1:])
    return mix((run[length:] - run[:n]) * _powers(n, kind, True))


def scan(texts: pa.Array, fold: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of an Arrow string column, some texts at a time (null: no words)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, "right")) - 1)
        j = min(j, n)
        yield Words(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], fold)
        i = j


def runs(at: np.ndarray) -> np.ndarray:
    """The group number of each element of consecutive groups that begin at ``at``."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
