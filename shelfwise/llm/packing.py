"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Each document is its tokens and a closing id.  Documents longer than a sequence
are cut into whole sequences, the first piece taking the remainder.  The pieces
shorter than a sequence are dealt to shards of bounded size; within one, longest
first, each goes where the sum over gaps g of N(g) squared, N(g) being the open
sequences with g places left, becomes smallest (a tie: the smaller gap); a new
sequence is begun only if no open one has room.  Then the sequences that stayed
far from full are opened again and dealt, as they are, to as many shards of that
size as their tokens need, until one shard is left or a round saves too few.

Only (id, piece, length) reach the packing; the tokens stay behind in a written table
with a number for each piece.  ``packed_tokens`` and ``sequences`` bring them together.

Edge cases: a null or empty text is one piece, the closing id alone; strings that the
tokenizer holds for special are one id each; equal lengths are ordered by id and piece;
repeated rows are packed as separate pieces; a null id is a document like any other; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import cut, table

LENGTH = 2048
CLOSING = 0
SHARD_TOKENS = 1 << 20
#: sequences with more of their places empty than this are packed again
SLACK = 0.01
#: share of its sequences that a round has to save if there is to be another one
SAVED = 0.001
#: rounds have numbers below this
ROUNDS = 32


def vocabulary() -> str:
    """The ranks file of the vocabulary in byte_bpe_50k.json; it gives the same ids, five times as fast."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def special_tokens() -> dict[str, int]:
    """The strings that the tokenizer of byte_bpe_50k.json takes whole wherever they stand, and their ids."""
    import json

    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(path: str, special: dict[str, int] | None = None):
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    special = special_tokens() if special is None else special
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _tokens(batches: Iterator[pa.RecordBatch], path: str, closing: int):
    """(batch, row, ids) of every document."""
    coder = encoder(path)
    for batch in batches:
        for row in range(batch.num_rows):
            ids = coder.encode(batch.column(1)[row].as_py() or "", allowed_special="all")
            yield batch, row, np.array([*ids, closing], "<u4")


def cuts(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole sequences after a first piece of the remainder."""
    first = total - (total - 1) // length * length
    return [(0, first)] + [(at, length) for at in range(first, total, length)]


def pieces(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, path: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, on request, the ids of every piece."""
    path = path or vocabulary()
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches):
        rows, source, ids = [], [], []

        def flush():
            columns = list(zip(*[r[1:] for r in rows]))
            out = [source[-1].column(0).take(pa.array([r[0] for r in rows])),
                   pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        for batch, row, found in _tokens(batches, path, closing):
            if rows and (source[-1] is not batch or len(rows) > 5000):
                yield flush()
                rows, source, ids = [], [], []
            source.append(batch)
            for k, (start, n) in enumerate(cuts(len(found), length)):
                part = found[start:start + n]
                rows.append((row, k, start, n, zlib.crc32(part.tobytes())))
                if with_ids:
                    ids.append(part.astype(np.int32))
        if rows:
            yield flush()

    return docs.mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the order given, by the sum-of-squares rule."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by gap
    count = np.zeros(capacity + 1, np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, none = 0, np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        # the change of the sum: 1 - 2 N(g) for leaving gap g, 1 + 2 N(g - n) for entering gap g - n,
        # nothing for entering the full ones
        change = 2 * (count[:capacity - n + 1] - count[n:]) + 2
        change[0] = 1 - 2 * count[n]
        change[count[n:] == 0] = none
        g = int(change.argmin()) + n
        if change[g - n] == none:
            g, s, made = capacity, made, made + 1
        else:
            s = open_[g].pop()
            count[g] -= 1
        sequence[i], offset[i] = s, capacity - g
        if g - n:
            open_[g - n].append(s)
            count[g - n] += 1
    return sequence, offset


def _packed(rows: DataFrame, capacity: int) -> DataFrame:
    """Packs each group; adds sequence, offset and its sequence's fill."""
    schema = T.StructType([f for f in rows.schema.fields] + [
        T.StructField("seq", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                               ("ids_crc32", "ascending")])
        lengths = group.column("length").to_numpy()
        seq, offset = place(lengths, capacity)
        fill = np.bincount(seq, lengths).astype(np.int64)[seq]
        return group.append_column("seq", pa.array(seq)).append_column("offset", pa.array(offset)) \
            .append_column("fill", pa.array(fill))

    return rows.groupBy("shard").applyInArrow(run, schema)


def pack(parts: DataFrame, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Adds (sequence_id, offset) to pieces that have doc_id, piece, start, length and ids_crc32."""
    parts = cut(parts, "pieces")
    short = parts.where(F.col("length") < length)
    tokens = short.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens))
    whole = parts.where(F.col("length") >= length) \
        .select("*", F.lit("w").alias("group"), F.monotonically_increasing_id().alias("seq"),
                F.lit(0).cast("long").alias("offset"))
    todo = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("long"))
    done, level, opened, before = [whole], 0, None, None
    while True:
        packed = cut(_packed(todo, length), "packed")
        group = F.concat(F.lit(f"{level}/"), F.col("shard").cast("string"))
        good = F.col("fill") >= length * (1 - SLACK)
        columns = [*parts.columns, group.alias("group"), "seq", "offset"]
        begins, loose = (F.col("offset") == 0).cast("long"), (~good).cast("long")
        made, left, tokens = [n or 0 for n in packed.agg(
            F.sum(begins), F.sum(begins * loose), F.sum(F.col("length") * loose)).first()]
        if before is not None and made >= opened:  # nothing saved: they stay as they were
            done.append(before)
            break
        few = opened is not None and opened - made < SAVED * opened
        if shards == 1 or not left or few or level == ROUNDS - 1:
            done.append(packed.select(*columns))
            break
        done.append(packed.where(good).select(*columns))
        before, opened = packed.where(~good).select(*columns), left
        deal = F.xxhash64("shard", "seq", F.lit(level))
        shards, level = max(1, -(-tokens // shard_tokens)), level + 1
        todo = packed.where(~good).select(*parts.columns, F.pmod(deal, F.lit(shards)).cast("long").alias("shard"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # group and number within it, as one long: a hash of 63 bits could collide, a rank would sort everything
    return out.select(*parts.columns, _sequence_id().alias("sequence_id"), "offset")


def _sequence_id():
    """Whole sequences get odd numbers; packed ones (seq, shard, level) as even mixed-radix numbers."""
    level = F.split("group", "/")[0]
    shard = F.split("group", "/")[1].cast("long")
    # a shard holds fewer than 2**25 sequences, a level fewer than 2**32 shards
    packed = (shard * (1 << 25) + F.col("seq")) * (2 * ROUNDS) + level.try_cast("long") * 2
    return F.when(F.col("group") == "w", F.col("seq") * 2 + 1).otherwise(packed).cast("long")


def packed_tokens(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, path: str | None = None) -> DataFrame:
    """Per piece what ``pack_documents`` gives, and its ``ids``: sequences by (sequence_id, offset)."""
    found = pieces(docs.select("doc_id", "text"), length, closing, path, with_ids=True)
    parts = cut(found.withColumn("number", F.monotonically_increasing_id()), "ids")  # the number is fixed with the table
    return pack(parts.drop("ids"), length).join(parts.select("number", "ids"), "number").drop("number")


def sequences(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, path: str | None = None) -> DataFrame:
    """The packed training sequences: (sequence_id, ids, doc_ids)."""
    # at most ``length`` pieces in a sequence
    return packed_tokens(docs, length, closing, path).groupBy("sequence_id") \
        .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p")) \
        .select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def pack_documents(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs.select("doc_id", "text"), length, closing, path), length)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
