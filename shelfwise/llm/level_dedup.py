"""Substring dedup by level-wise doubling.

A word of a document goes if a window of ``window`` words that covers it also
starts in a document with a smaller id.  The search climbs from half the window:

1. documents with the same word sequence form a class; all but the smallest id
   are removed whole (each word lies in a window of the smallest) and don't go on;
2. level 1, windows of half the length: each full window contains many of them,
   and the one with the smallest hash, its anchor, is the same wherever the full
   window occurs.  Only anchors are dealt out, a dozenth of all positions;
   those seen in one document alone drop out, and with them every full
   window whose anchor they are;
3. level 2, twice the length: the full windows around the surviving anchors are
   dealt out by a 128-bit hash; one that occurs in several documents marks its
   words in all but the smallest.  Anything longer repeats only where these do.

``longest_repeats`` goes on doubling: windows that repeat at one length are
extended to twice that length until no candidate survives.

Counts are aggregated before they are shuffled, and each window meets the small
table of repeated windows in a join that Spark may split, so a passage shared by
any number of documents is no hot spot.

Edge cases: a null or blank text has no words (nothing removed, the hash of the
empty text); a text shorter than the window keeps everything; a window repeated
within one document only stays; rows with the same id are equal, not smaller, and
each is judged by its own text; a null id is neither smaller nor larger, so the
row keeps everything; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import cut, lean, table
from shelfwise.llm.text import scan, window_hashes

WINDOW = 50


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.empty(0, kind)))


def _anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one text's word hashes: the half windows' hashes and, per full window, its anchor's position."""
    half = window // 2
    low = window_hashes(h, half)
    span = window - half + 1
    at = np.arange(len(low) - span + 1) + sliding_window_view(low, span).argmin(axis=1)
    return low, at


def _joined(w, i: int, keep: np.ndarray | None = None) -> bytes:
    """The (kept) words of text ``i``, joined by one space."""
    a, b = w.at[i], w.at[i + 1]
    s, e = w.starts[a:b], w.ends[a:b]
    if keep is not None:
        s, e = s[keep], e[keep]
    if not len(s):
        return b""
    # copy each word and the byte behind it, then turn that byte into a space
    n = e - s + 1
    out = np.empty(int(n.sum()), np.uint8)
    to = np.concatenate([[0], np.cumsum(n)])
    src = np.arange(len(out)) + np.repeat(s - to[:-1], n)
    np.minimum(src, len(w.data) - 1, out=src)
    out[:] = w.data[src]
    out[to[1:] - 1] = 32
    return out[:-1].tobytes()


def _first_pass(docs: DataFrame, window: int) -> DataFrame:
    ids = docs.schema["doc_id"].dataType
    others = docs.schema.fields[2:]
    schema = T.StructType([T.StructField("doc_id", ids), T.StructField("n_words", T.LongType()),
                           T.StructField("sha", T.StringType()),
                           T.StructField("anchors", T.ArrayType(T.LongType())), *others])

    def run(batches):
        for batch in batches:
            for w in scan(batch.column(1)):
                h, _ = w.hashes()
                sha, anchors = [], []
                for i in range(w.n_texts):
                    sha.append(hashlib.sha256(_joined(w, i)).hexdigest())
                    own = h[w.at[i]:w.at[i + 1]]
                    if len(own) >= window:
                        low, at = _anchors(own, window)
                        anchors.append(np.unique(low[np.unique(at)]).view(np.int64))
                    else:
                        anchors.append(np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.n_texts), pa.array(np.diff(w.at).astype(np.int64)),
                     pa.array(sha), _lists(anchors, np.int64),
                     *[batch.column(2 + k).slice(w.first, w.n_texts) for k in range(len(others))]], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def _full_windows(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, start, h, g) of the full windows whose anchor is among the row's ``hits``."""
    ids = texts.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", ids), T.StructField("row", T.LongType()),
                           T.StructField("at", T.ArrayType(T.IntegerType())),
                           T.StructField("h", T.ArrayType(T.LongType())),
                           T.StructField("g", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            hits = batch.column(2)
            for w in scan(batch.column(1)):
                h, other = w.hashes()
                at, hs, gs = [], [], []
                for i in range(w.n_texts):
                    own = h[w.at[i]:w.at[i + 1]]
                    if len(own) < window:  # another row of a repeated id
                        at.append(np.empty(0, np.int32))
                        hs.append(np.empty(0, np.int64))
                        gs.append(np.empty(0, np.int64))
                        continue
                    hit = np.sort(np.asarray(hits[w.first + i].as_py(), np.int64).view(np.uint64))
                    low, anchor = _anchors(own, window)
                    found = np.searchsorted(hit, low)
                    known = hit[np.minimum(found, len(hit) - 1)] == low
                    starts = np.flatnonzero(known[anchor])
                    at.append(starts.astype(np.int32))
                    hs.append(window_hashes(own, window)[starts].view(np.int64))
                    gs.append(window_hashes(other[w.at[i]:w.at[i + 1]], window, kind=2)[starts].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.n_texts), batch.column(3).slice(w.first, w.n_texts),
                     _lists(at, np.int32), _lists(hs, np.int64), _lists(gs, np.int64)], names=schema.names)

    packed = texts.select("doc_id", "text", "hits", "row").mapInArrow(lean(run), schema)
    return packed.select("doc_id", "row", F.inline(F.arrays_zip("at", "h", "g"))) \
        .toDF("doc_id", "row", "start", "h", "g")


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def _last_pass(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """What is left of each text."""
    ids = texts.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", ids), T.StructField("row", T.LongType()),
              T.StructField("cut_removed", T.LongType()), T.StructField("cut_sha", T.StringType())]
    if with_text:
        fields += [T.StructField("cut_text", T.StringType())]
    schema = T.StructType(fields)

    def run(batches):
        for batch in batches:
            starts = batch.column(3)
            for w in scan(batch.column(2)):
                removed, sha, kept = [], [], []
                for i in range(w.n_texts):
                    n = int(w.at[i + 1] - w.at[i])
                    gone = _cover(np.asarray(starts[w.first + i].as_py(), np.int64), n, window)
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(_joined(w, i, ~gone)).hexdigest())
                    if with_text:
                        kept.append(_kept_text(w, i, ~gone))
                arrays = [batch.column(0).slice(w.first, w.n_texts), batch.column(1).slice(w.first, w.n_texts),
                          pa.array(removed, pa.int64()), pa.array(sha)]
                if with_text:
                    arrays.append(pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return texts.select("doc_id", "row", "text", "starts").mapInArrow(lean(run), schema)


def _kept_text(w, i: int, keep: np.ndarray) -> str:
    """The text without the words that go; the white space before each kept word stays."""
    a, b = w.at[i], w.at[i + 1]
    begin = np.concatenate([[w.bounds[i]], w.ends[a:b]])[:-1]
    pieces, k = [], np.flatnonzero(keep)
    if len(k):
        new = np.flatnonzero(np.concatenate([[True], np.diff(k) > 1]))
        last = np.concatenate([new[1:], [len(k)]]) - 1
        pieces = [w.data[begin[k[p]]:w.ends[a + k[q]]].tobytes() for p, q in zip(new, last)]
    return b"".join(pieces).decode("utf-8", "replace").strip(" \t\n\x0b\x0c\r")


def _repeated(docs: DataFrame, window: int, fold: bool = True):
    """First pass with each row's class, and the texts with the starts of their repeated windows.

    With ``fold`` a class counts as its smallest id alone, else all of its copies count.
    """
    first = cut(_first_pass(docs, window), "first")
    long_ = first.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    classes = cut(long_.groupBy("sha", "n_words").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("c"))
                  .where("c > 1").select("sha", "n_words", "smallest"), "classes")
    own = long_
    if fold:
        own = long_.join(classes, ["sha", "n_words"], "left") \
            .where(F.col("doc_id") == F.coalesce("smallest", "doc_id"))
    marks = own.select("doc_id", F.explode("anchors").alias("h"))
    shared = marks.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    hits = marks.join(cut(shared.select("h"), "shared"), "h").groupBy("doc_id").agg(F.collect_set("h").alias("hits"))
    # the rows of a repeated id share their hits; each looks for them in its own text
    texts = cut(docs.where("doc_id is not null").join(cut(hits, "hits"), "doc_id")
                .select("doc_id", "text", "row", "hits"), "texts")
    return first, classes, texts


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text",
                    with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, on request, ``kept_text``.

    ``kept_text`` is null for rows that lose nothing, so that their texts need no shuffle;
    with it goes ``row``, a hash of the text, which tells rows with one id apart.
    """
    key = ["doc_id", "row"]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    first, classes, texts = _repeated(docs, window)
    wide = cut(_full_windows(texts, window), "windows")
    found = wide.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")) \
        .where("lo < hi").select("h", "g", "lo")
    starts = wide.join(cut(found, "found"), ["h", "g"]).where("lo < doc_id") \
        .groupBy(*key).agg(F.collect_set("start").alias("starts"))
    hit = texts.drop("hits").join(cut(starts, "starts"), key)
    done = cut(_last_pass(hit, window, with_text).dropDuplicates(key), "done")
    rows = first.drop("anchors").join(classes, ["sha", "n_words"], "left").join(done, key, "left")
    whole = F.coalesce(F.col("smallest") < F.col("doc_id"), F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    out = [F.col("doc_id"), F.col("n_words"),
           F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut_removed", F.lit(0).cast("long"))).alias("n_removed"),
           F.when(whole, F.lit(empty)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256")]
    if with_text:
        out += [F.col("row"), F.when(whole, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text")]
    return rows.select(*out)


def longest_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, start, length): per start, the longest doubled length that repeats in another document.

    From the windows that repeat at ``window`` words, each level pairs a window
    with the one that begins where it ends; pairs seen in one document alone
    drop out, and the loop ends when none survive.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    _, _, texts = _repeated(docs, window, fold=False)
    level, length, done = cut(_full_windows(texts, window), "windows"), window, None
    while True:
        shared = level.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        level = cut(level.join(cut(shared.select("h", "g"), "shared"), ["h", "g"]), "level")
        if level.isEmpty():
            return done if done is not None else level.select("doc_id", "row", "start", F.lit(length).alias("length"))
        now = level.select("doc_id", "row", "start", F.lit(length).alias("length"))
        done = now if done is None else cut(
            done.union(now).groupBy("doc_id", "row", "start").agg(F.max("length").alias("length")), "lengths")
        after = level.select("doc_id", "row", (F.col("start") - length).alias("start"),
                             F.col("h").alias("h2"), F.col("g").alias("g2"))
        level = cut(level.join(after, ["doc_id", "row", "start"]).select(
            "doc_id", "row", "start", F.xxhash64("h", "g", "h2", "g2").alias("h"),
            F.xxhash64("g2", "h2", "g", "h").alias("g")), "pairs")
        length *= 2


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL = {
    "op3_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g
        from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
lo as (select g, min(doc_id) as lo from win group by g),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join lo using (g) where lo.lo < win.doc_id),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select word.doc_id, string_agg(x, ' ' order by word.p) as t
         from word left join gone on gone.doc_id = word.doc_id and gone.p = word.p where gone.p is null group by word.doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n.n, 0)::bigint as n_removed,
  sha256(coalesce(kept.t, '')) as kept_sha256
from d left join n on n.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
""",
}
