"""MinHash near-dedup with SetSketch registers.

A text's set is its distinct word shingles.  A sketch has ``M`` registers; each
keeps the minimum, over the set, of an exponential variable per shingle, on an
exponentially spaced scale: ``K = floor(1 - log_B(min))``, truncated to 16 bits.
Registers merge by maximum and two sets agree in a register with a probability
of at least their Jaccard similarity.  Steps:

1. sketch every text; texts with the same set (128-bit fingerprint and size)
   form one class, and only its smallest id goes on;
2. band the registers (4 each): ids that share a band are candidates.  In each
   bucket every member is tried with the bucket's hub, the member that shares
   the most buckets with others, so a bucket gives as many pairs as members;
3. estimate the similarity jointly by likelihood from the registers, drop pairs
   far below the bound, and verify the rest on the full shingle sets;
4. link up; buckets whose members are still in different components are then
   compared completely: small buckets pair by pair, larger ones in blocks of members.
   A block's task lists no pairs.  It looks up, for each member, those that share one
   of its rarest shingles (an exact prefix filter), asks the estimate, and verifies a
   pair only while its components are apart, so fewer edges leave it than it has members.

At similarity 0.8 a pair shares none of the 32 bands with probability 5e-8, and
the estimate drops it with 1e-5.

Edge cases: without words or text the set is empty and linked with nothing;
with fewer words than a shingle the whole sequence is the one shingle; rows
with the same set, repeated rows included, link; a null id links with nothing
(component null, kept); an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import components, cut, lean, table, trim
from shelfwise.llm.text import mix, runs, scan, window_hashes

M = 128
BAND = 4  # registers of 16 bits: one band is one long
B = 1.001
TOP = 65535
#: -log_B(1 / OFFSET) places the scale so that sets of 1 to 1e9 shingles use the middle of it.
OFFSET = 1e12
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: buckets of so few members are compared pair by pair
SMALL = 8
TASK = ("band", "value", "b1", "b2")
#: standard errors of the estimate below the bound at which a pair is dropped
MARGIN = 4.5



def _salt(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))


def shingles(words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct shingles of a run of texts."""
    h, at = words.hashes()[0], words.at
    n = np.diff(at)
    full = window_hashes(h, size)
    text = runs(at)
    left = at[1:][text] - np.arange(len(h))  # words from here to the text's end
    ok = np.flatnonzero(left >= size)
    parts, owner = [full[ok]], [text[ok]]
    for k in range(1, size):  # short texts: one shingle of all their words
        short = np.flatnonzero(n == k)
        if len(short):
            parts.append(window_hashes(h, k)[at[short]] + np.uint64(k))
            owner.append(short)
    s, o = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    return s[new], o[new]


def registers(s: np.ndarray, o: np.ndarray, n_texts: int) -> np.ndarray:
    """Sketches, as uint16, of the sets given by (hash, text number).

    Each shingle is a Poisson process of rate M whose points fall on random
    registers, so each register sees an exponential first point; a process is
    followed until it has passed the text's largest register.
    """
    low = np.full((n_texts, M), np.inf)
    flat = low.reshape(-1)
    seed, owner = mix(s ^ _salt(1)), o
    t = np.zeros(len(s))
    r = 0
    while len(seed):
        r += 1
        u = mix(seed + _salt(r))
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / M
        reg = (mix(u) & np.uint64(M - 1)).astype(np.int64)
        np.minimum.at(flat, owner * M + reg, t)
        on = t < low.max(axis=1)[owner]
        seed, owner, t = seed[on], owner[on], t[on]
    with np.errstate(divide="ignore"):
        k = np.floor(1 + np.log(OFFSET / low) / np.log(B))
    return np.clip(k, 0, TOP).astype(np.uint16)


def similarity(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the greatest likelihood given both sketches and set sizes."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def score(j):
        x, y = p(u - v * j), p(v - u * j)
        eps = 1e-12
        return more * np.log(x + eps) + less * np.log(y + eps) + same * np.log(np.maximum(1 - x - y, eps))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one maximum
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = score(a) > score(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def _floor(bound: float) -> float:
    return bound - MARGIN * float(np.sqrt(bound * (1 - bound) / M))


def _unpack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint16).reshape(-1, M)


def sketch(docs: DataFrame, size: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, fp1, fp2, regs) of every row; regs: 32 longs of four registers each, null if empty."""
    ids = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", ids), T.StructField("n", T.LongType()),
                           T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType()),
                           T.StructField("regs", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for w in scan(batch.column(1), fold=True):
                s, o = shingles(w, size)
                n = np.bincount(o, minlength=w.n_texts)
                at = np.zeros(w.n_texts + 1, np.int64)
                np.cumsum(n, out=at[1:])
                fps = []
                for salt in (1, 2):
                    run_ = np.zeros(len(s) + 1, np.uint64)
                    np.cumsum(mix(s + _salt(salt)), out=run_[1:])
                    fps.append((run_[at[1:]] - run_[at[:-1]]).view(np.int64))
                regs = registers(s, o, w.n_texts).view(np.int64)
                full = n > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(full * (M // BAND))]).astype(np.int32)),
                    pa.array(regs[full].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.n_texts), pa.array(n), pa.array(fps[0]),
                     pa.array(fps[1]), lists], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), schema)


def _estimated(pairs: DataFrame, reps: DataFrame, bound: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity isn't far below the bound."""
    ra = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    rb = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    both = pairs.join(ra, "a").join(rb, "b").select("a", "b", "na", "nb", "ra", "rb")
    floor = _floor(bound)
    schema = T.StructType([both.schema["a"], both.schema["b"]])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
                ok = (np.minimum(na, nb) >= bound * np.maximum(na, nb) - 1e-9) \
                    & (similarity(_unpack(batch.column(4)), _unpack(batch.column(5)), na, nb) >= floor)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]) \
                    .filter(pa.array(ok))

    return both.mapInArrow(lean(run), schema)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach ``percent`` of similarity."""
    ta = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    schema = T.StructType([both.schema["a"], both.schema["b"]])

    def run(batches):
        cache: dict = {}

        def sets(column, ids):
            fresh = list(dict.fromkeys(i for i in ids if i not in cache))
            if fresh:
                first = {i: k for k, i in reversed(list(enumerate(ids)))}
                part = column.take(pa.array([first[i] for i in fresh]))
                for w in scan(part, fold=True):
                    s, o = shingles(w, size)
                    at = np.searchsorted(o, np.arange(w.n_texts + 1))
                    for k in range(w.n_texts):
                        cache[fresh[w.first + k]] = s[at[k]:at[k + 1]].copy()

        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                if sum(map(len, cache.values())) > 4_000_000:
                    cache.clear()
                sets(batch.column(2), a)
                sets(batch.column(3), b)
                ok = []
                for x, y in zip(a, b):
                    ok.append(_near(cache[x], cache[y], percent))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]) \
                    .filter(pa.array(ok))

    return both.mapInArrow(lean(run), schema)


def _open(members: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that still hold several components."""
    named = cut(members.join(labels, members["rep"] == labels["node"], "left").join(reps.select("rep", "n"), "rep")
                .select("band", "value", "rep", "n", F.coalesce("component", "rep").alias("component")), "named")
    open_ = named.groupBy("band", "value").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"),
        F.sum("n").alias("total")).where("lo < hi").select("band", "value", "c", "total")
    return cut(named.join(cut(open_, "open"), ["band", "value"]), "rest")


def _small(rows: DataFrame) -> DataFrame:
    """All pairs from different components of the buckets of at most SMALL members."""
    groups = rows.where(F.col("c") <= SMALL).groupBy("band", "value") \
        .agg(F.collect_list(F.struct("rep", "component")).alias("g"))
    one = groups.select("g", F.explode("g").alias("x"))
    return one.select("x", F.explode("g").alias("y")).where("x.rep < y.rep and x.component <> y.component") \
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _blocks(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """The larger buckets dealt to tasks (band, value, b1, b2) of two blocks, with sizes and registers.

    A block has at most BLOCK members and BLOCK_SHINGLES shingles on average.
    """
    n_blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), n_blocks).cast("int")
    rows = rows.where(F.col("c") > SMALL).select("band", "value", "rep", "component", n_blocks.alias("nb"), mine.alias("mine"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))) \
        .select("band", "value", "rep", "component", "mine", F.least("mine", "other").alias("b1"),
                F.greatest("mine", "other").alias("b2"))
    return rows.join(reps.select("rep", "n", "regs"), "rep")


class _Task:
    """The members of two blocks, and which pairs of them a task has to look at."""

    def __init__(self, group: pa.Table, bound: float):
        self.band, self.b1, self.b2 = (group.column(c)[0].as_py() for c in ("band", "b1", "b2"))
        self.key = group.column("rep").to_numpy()
        self.mine = group.column("mine").to_numpy()
        _, self.comp = np.unique(group.column("component").to_numpy(), return_inverse=True)
        self.n = group.column("n").to_numpy().astype(float)
        self.regs = np.concatenate([_unpack(c) for c in group.column("regs").chunks])
        self.bands = self.regs.view(np.int64)
        self.bound, self.floor = bound, _floor(bound)

    def partners(self, i: int, js: np.ndarray) -> np.ndarray:
        """Of the members ``js``, those of other components whose similarity to ``i`` isn't estimated far below the bound.

        A pair is looked at in the first band that it shares, by its smaller member
        within a block and by the first block's between two.
        """
        js = js[self.comp[js] != self.comp[i]]
        js = js[(self.key[js] > self.key[i]) if self.b1 == self.b2 else (self.mine[js] != self.mine[i])]
        js = js[np.minimum(self.n[js], self.n[i]) >= self.bound * np.maximum(self.n[js], self.n[i]) - 1e-9]
        if self.band:
            js = js[~(self.bands[js, :self.band] == self.bands[i, :self.band]).any(axis=1)]
        js = js[(self.regs[js] == self.regs[i]).mean(axis=1) >= self.floor - 0.02]  # cheaper than the likelihood
        if len(js):
            est = similarity(np.repeat(self.regs[i:i + 1], len(js), 0), self.regs[js], np.full(len(js), self.n[i]), self.n[js])
            js = js[np.argsort(-est, kind="stable")][:int((est >= self.floor).sum())]
        return js

    def first(self) -> np.ndarray:
        return np.flatnonzero(self.mine == self.b1)


def _in_question(blocks: DataFrame, bound: float) -> DataFrame:
    """The rows of members with a partner in their task: only their texts need to be looked at."""
    schema = T.StructType([blocks.schema[c] for c in (*TASK, "rep")])

    def run(group: pa.Table) -> pa.Table:
        task = _Task(group, bound)
        used = np.zeros(len(task.key), bool)
        others = np.flatnonzero(task.mine == task.b2)
        for i in task.first():
            js = task.partners(i, others)
            used[i] |= len(js) > 0
            used[js] = True
        out = group.select([*TASK, "rep"]).filter(pa.array(used))
        if len(used) >= BLOCK:
            trim()
        return out

    return blocks.groupBy(*TASK).applyInArrow(run, schema)


def _prefixes(s: np.ndarray, o: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, member) of the rarest shingles of each set, as many as sets near enough must share one of.

    Two sets of which one has n shingles and that are similar enough share at least
    ``percent`` of these n, so with all shingles in one order, here by rarity, they
    share one of the first n - percent * n + 1.
    """
    _, which, count = np.unique(s, return_inverse=True, return_counts=True)
    order = np.lexsort((which, count[which], o))
    s, o, count = s[order], o[order], count[which][order]
    n = np.bincount(o)
    at = np.concatenate([[0], np.cumsum(n)])[:-1]
    keep = np.arange(len(s)) - at[o] < (n - (n * percent + 99) // 100 + 1)[o]
    keep &= count > 1  # a shingle of one member is shared with none
    return s[keep], o[keep]


def _joined(asked: DataFrame, blocks: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that join the components of a task's members whose full sets are near enough.

    A pair is verified if it shares a shingle of both prefixes, isn't estimated far below
    the bound, and its members' components, as found so far, are apart.  Only the
    edges leave the task: fewer than it has members.
    """
    rows = asked.join(blocks, [*TASK, "rep"]).join(texts.select("rep", "text"), "rep") \
        .select(*TASK, "rep", "component", "mine", "n", "regs", "text")
    schema = T.StructType([T.StructField("a", rows.schema["rep"].dataType), T.StructField("b", rows.schema["rep"].dataType)])

    def run(group: pa.Table) -> pa.Table:
        task = _Task(group, percent / 100)
        parts = []
        for w in scan(group.column("text"), fold=True):
            s, o = shingles(w, size)
            parts.append((s, o + w.first))
        s, o = (np.concatenate(x) for x in zip(*parts))
        at = np.searchsorted(o, np.arange(len(task.key) + 1))
        ps, po = _prefixes(s, o, percent)
        by_member = np.searchsorted(po, np.arange(len(task.key) + 1))
        order = np.argsort(ps, kind="stable")
        shingle, member = ps[order], po[order]
        second = task.mine == task.b2
        a, b = [], []
        for i in task.first():
            own = ps[by_member[i]:by_member[i + 1]]
            lo, hi = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
            if not len(own):
                continue
            js = np.unique(np.concatenate([member[x:y] for x, y in zip(lo.tolist(), hi.tolist())]))
            for j in task.partners(i, js[second[js]]):
                if task.comp[i] != task.comp[j] and _near(s[at[i]:at[i + 1]], s[at[j]:at[j + 1]], percent):
                    task.comp[task.comp == task.comp[j]] = task.comp[i]
                    a.append(task.key[i])
                    b.append(task.key[j])
        kind = group.schema.field("rep").type
        if len(task.key) >= BLOCK:
            trim()
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    return rows.groupBy(*TASK).applyInArrow(run, schema)


def _near(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    common = len(p) + len(q) - len(np.union1d(p, q))
    return 100 * common >= percent * (len(p) + len(q) - common)


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80,
               id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable) and kept."""
    bound = percent / 100
    sk = cut(sketch(docs, size, id_col, text), "sketch")
    full = sk.where("n > 0 and doc_id is not null")
    same = ["fp1", "fp2", "n"]
    reps = cut(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")), "reps")
    banded = reps.select("rep", F.posexplode("regs").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.count("*").alias("c")).where("c > 1")
    members = cut(banded.join(cut(shared, "buckets"), ["band", "value"]), "members")
    share = members.groupBy("rep").agg(F.sum("c").alias("share"))
    scored = members.join(share, "rep")
    hubs = cut(scored.groupBy("band", "value").agg(
        F.max_by("rep", F.struct("share", F.xxhash64("rep"))).alias("hub")), "hubs")
    star = members.join(hubs, ["band", "value"]).where("rep <> hub") \
        .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    near = _estimated(star, reps, bound)
    ids = members.select("rep").distinct()
    texts = cut(docs.select(F.col(id_col).alias("rep"), F.col(text).alias("text"))
                .join(ids, "rep"), "texts")
    links = cut(_verified(near, texts, size, percent), "links")
    labels = components(links)
    rest = _open(members, reps, labels)
    few = _estimated(_small(rest), reps, bound)
    blocks = _blocks(rest, reps)
    more = _verified(few, texts, size, percent) \
        .union(_joined(cut(_in_question(blocks, bound), "asked"), blocks, texts, size, percent))
    more = cut(more, "more")
    if not more.isEmpty():
        labels = components(links.union(more))
    of = reps.join(labels, reps["rep"] == labels["node"], "left") \
        .select(*same, F.coalesce("component", "rep").alias("component"))
    rows = sk.select("doc_id", *same).join(cut(of, "of"), same, "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")) \
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), size=4)


ORACLE_SQL = {
    "op9_near_dedup": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from d where len(w) >= 4)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 3),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b
                       where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from d union select r.a, l.b from reach r join links l on l.a = r.b),
low as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, low.component_id, d.doc_id = low.component_id as kept
from d join low on low.a = d.doc_id left join n on n.doc_id = d.doc_id
""",
}
