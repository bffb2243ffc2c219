"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of bytes, the
largest response of each filter goes through a softmax.  The network is trained
with numpy on the driver, on a bounded sample of labelled texts (PER_LABEL a
language, EXCERPTS windows a text), and applied to every window of every whole
text, many windows to a matrix product; a text's prediction is the mean of its
windows' probabilities, weighted by their bytes.

Edge cases: a null text or one without a letter is ``und`` with score 0; a text
shorter than a window is padded with zeros, which embed as zeros; equal
probabilities go to the language first in code-point order; repeated rows get
equal results; without any labelled row every prediction is ``und``; a row without
an id is predicted, but is neither held out nor learned from; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
EMBED = 8
#: bound of the sample that the network is trained on
PER_LABEL = 400
EXCERPTS = 4
EPOCHS = 8
BATCH = 64
SEED = 11
_RATE = 10 ** 6


class Network:
    """Embedding, filters as one matrix over the largest width, and the softmax layer."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.labels = labels
        self.mask = np.zeros((wide * EMBED, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width * EMBED, k * FILTERS:(k + 1) * FILTERS] = 1
        self.p = {"e": rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5,
                  "w": rng.standard_normal((wide * EMBED, n)).astype(np.float32) * 0.3 * self.mask,
                  "b": np.zeros(n, np.float32),
                  "u": rng.standard_normal((n, len(labels))).astype(np.float32) * 0.2,
                  "c": np.zeros(len(labels), np.float32)}
        self.p["e"][0] = 0

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows * WINDOW, width * EMBED): the embedded bytes under the filters at each place."""
        wide = max(WIDTHS)
        padded = np.zeros((len(x), WINDOW + wide - 1), np.uint8)
        padded[:, :WINDOW] = x
        e = self.p["e"][padded]
        return np.concatenate([e[:, k:k + WINDOW] for k in range(wide)], axis=2).reshape(-1, wide * EMBED)

    def _pooled(self, x: np.ndarray, columns: np.ndarray):
        r = (columns @ self.p["w"]).reshape(len(x), WINDOW, -1)
        return r

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(windows, labels) probabilities of (windows, WINDOW) bytes."""
        top = self._pooled(x, self._columns(x)).max(axis=1) + self.p["b"]
        return self._softmax(np.maximum(top, 0) @ self.p["u"] + self.p["c"])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the cross entropy; the gradient reaches a filter at its largest response only."""
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        wide, step = max(WIDTHS), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                at = order[lo:lo + BATCH]
                xb, yb, n = x[at], y[at], len(at)
                columns = self._columns(xb)
                r = self._pooled(xb, columns)
                where = r.argmax(axis=1)
                top = np.take_along_axis(r, where[:, None, :], 1)[:, 0] + self.p["b"]
                h = np.maximum(top, 0)
                d = self._softmax(h @ self.p["u"] + self.p["c"])
                d[np.arange(n), yb] -= 1
                d /= n
                g = {"u": h.T @ d, "c": d.sum(axis=0)}
                dh = (d @ self.p["u"].T) * (top > 0)
                g["b"] = dh.sum(axis=0)
                seen = columns.reshape(n, WINDOW, -1)[np.arange(n)[:, None], where]  # (n, filters, width * EMBED)
                g["w"] = np.einsum("nf,nfk->kf", dh, seen) * self.mask
                de = np.einsum("nf,kf->nfk", dh, self.p["w"]).reshape(-1, EMBED)
                place = where[:, :, None] + np.arange(wide)
                byte = np.where(place < WINDOW, np.take_along_axis(
                    xb, np.minimum(place, WINDOW - 1).reshape(n, -1), 1).reshape(place.shape), 0)
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], byte.reshape(-1), de)
                g["e"][0] = 0
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - np.float32(0.01) * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of consecutive texts: bytes (zero-padded), text number, bytes used."""
    n = np.diff(bounds)
    per = -(-n // WINDOW)
    owner = np.repeat(np.arange(len(n)), per)
    start = bounds[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    used = np.minimum(bounds[1:][owner] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < used[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8), owner, used


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang",
          per_label: int = PER_LABEL) -> Network | None:
    """A network fitted on at most ``per_label`` rows of each label, chosen by a hash of the id."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per language
    if not counts:
        return None
    place = F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(_RATE))
    some = F.lit(False)
    for name, n in sorted(counts.items()):  # a few more than needed, then the first by hash
        some = some | ((F.col(label) == name) & (place < min(1.0, (per_label + 4 * per_label ** 0.5) / n) * _RATE))
    at = lambda k: 1 + F.pmod(F.xxhash64(id_col, F.lit(k)), F.greatest(F.lit(1), F.length(text) - WINDOW + 1))
    sample = rows.where(some).select(
        F.col(label).alias("label"), F.xxhash64(id_col, F.lit(SEED)).alias("order"),
        F.array(*[F.col(text).substr(at(k).cast("int"), F.lit(WINDOW)) for k in range(EXCERPTS)]).alias("excerpts"))
    found = sorted(tuple(r) for r in sample.collect())
    labels, taken, x, y = sorted(counts), dict.fromkeys(counts, 0), [], []
    for name, _, excerpts in found:
        taken[name] += 1
        if taken[name] <= per_label:
            for e in dict.fromkeys(excerpts):
                raw = e.encode()[:WINDOW]
                x.append(np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8))
                y.append(labels.index(name))
    return Network(labels).fit(np.stack(x), np.array(y))


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred and score."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
            total = np.zeros((len(texts), len(network.labels) if network else 1))
            lo = 0
            while network and lo < len(texts):  # about 256 KB at a time, however long a text is
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + (1 << 18), "right")) - 1)
                hi = min(hi, len(texts))
                for a in range(bounds[lo], max(bounds[hi], bounds[lo] + 1), WINDOW << 10):
                    b = min(bounds[hi], a + (WINDOW << 10))
                    own = np.clip(bounds[lo:hi + 1], a, b) if hi == lo + 1 else bounds[lo:hi + 1]
                    x, owner, used = windows(data, own)
                    if len(x):
                        np.add.at(total, lo + owner, network.predict(x) * used[:, None])
                    if hi > lo + 1:
                        break
                lo = hi
            weight = total.sum(axis=1)
            ok = lettered & (weight > 0)
            best = total.argmax(axis=1)
            names = network.labels if network else ["und"]
            pred = [names[k] if good else "und" for k, good in zip(best, ok)]
            score = np.where(ok, total.max(axis=1) / np.where(weight > 0, weight, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()),
                                              pa.array(np.clip(score, 0, 1))], names=schema.names)

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), letter.alias("letter")) \
        .mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training by its id; false without one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    network = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs, network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
