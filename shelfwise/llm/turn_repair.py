"""Conversation structure repair by depth-first branch-and-bound.

A conversation should be an optional system turn and then pairs of a user's and an
assistant's turn.  Each row is kept, given another role or deleted, and empty turns
are inserted, at the least total cost and, of equal ones, with the audit (the edits'
initials in order) that is least in ASCII.

The rows of all conversations are sorted by range, so that one of any length is dealt
over many tasks, and searched in blocks of ``BLOCK`` rows.  The search of a block
keeps an explicit stack of prefixes (rows done, role state, cost, audit).  A prefix is
dropped if its cost and a lower bound of what the rest costs exceed the incumbent, if
it can only tie with it on a greater audit, or if a table per (rows done, state) holds
a better prefix; when the stack is empty the incumbent is proved.  A block in which a
conversation may begin or end elsewhere is solved for each state at its entry and
exit, and these small tables are put together per conversation in the order of their
blocks.  Only hashes, roles' initials and faults are sorted and searched; the texts
meet the edits at the end.

What one task holds: two blocks' rows, or the tables of one conversation, about twelve
bytes a row of it, not texts.  Only its digest, which is sequential by definition, reads a
conversation's texts in one task, one batch at a time.  Equal rows of a conversation
(same turn, role, text) are counted before they are shuffled.

Edge cases: rows are taken by turn, nulls first, and of equal turns by a hash of the
row; repeated rows follow one another; a null role or text counts as one space, null
ids are one conversation; a conversation of blanks alone is deleted whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import cut, table

BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # what the last turn made so far is
#: the states that may end a conversation, and the cost and audit of what others still need
TAIL = {NOTHING: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the turn that may be inserted
ROLE = {USER: "user", ASSISTANT: "assistant"}
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
SPACES = " \t\n\x0b\x0c\r"
CONV = "__conv"


class Row(NamedTuple):
    code: int  # the state that its role leads to; 0: none that is known
    fault: int
    copies: int


def _leads(state: int, code: int) -> bool:
    """Whether a turn of the role may follow."""
    return code == SYSTEM and state == NOTHING or code == NEXT[state]


#: states from which a search may still reach its goal; from any the states of a pair
REACHES = {NOTHING: (NOTHING,), SYSTEM: (NOTHING, SYSTEM)}


def _steps(row: Row, state: int) -> list[tuple[int, int, str]]:
    """(next state, cost, audit) of the edits that a row may get."""
    after, again = "D" * (row.copies - 1), DELETE * (row.copies - 1)
    out = [(state, DELETE + again, "D" + after)]
    if row.fault not in (BLANK, DUPLICATE):
        again += TRUNCATED if row.fault == CUT_OFF else 0
        if _leads(state, row.code):
            out.append((row.code, KEEP + again, "K" + after))
        out.append((NEXT[state], REROLE + again, "R" + after))
    return out


def bounds(rows: list[Row]) -> list[list[int]]:
    """Per place and state, what the rows from there on cost at least if they may end in any state."""
    out = [[0] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows) - 1, -1, -1):
        for state in range(4):
            out[i][state] = min(cost + out[i + 1][to] for to, cost, _ in _steps(rows[i], state))
        for _ in range(2):  # after two inserted turns the state is one that was there before
            out[i] = [min(out[i][s], INSERT + out[i][NEXT[s]]) for s in range(4)]
    return out


def search(rows: list[Row], entry: int = NOTHING, goal: int | None = None,
           rest: list[list[int]] | None = None) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from one state to another, or to the end without ``goal``.

    ``rest``: the rows' bounds, if they are at hand.
    """
    n, rest = len(rows), rest or bounds(rows)
    best: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}  # per node, the best prefix so far
    stack, found = [(0, entry, 0, "")], None
    while stack:
        i, state, cost, audit = stack.pop()
        if best[i, state] != (cost, audit) or state not in REACHES.get(goal, TAIL):
            continue  # a better prefix came after this one, or there is no way back to the goal
        if found is not None:
            least = cost + rest[i][state]
            if least > found[0] or least == found[0] and audit > found[1][:len(audit)]:
                continue
        if i == n:
            more, tail = TAIL[state] if goal is None else (0, "")
            if goal in (None, state) and (found is None or (cost + more, audit + tail) < found):
                found = cost + more, audit + tail
            continue
        steps = [(i + 1, to, cost + c, audit + a) for to, c, a in _steps(rows[i], state)]
        if rows[i].fault not in (BLANK, DUPLICATE):  # before a row that goes, a turn may as well come later
            steps.append((i, NEXT[state], cost + INSERT, audit + "I"))
        # the most promising goes on top
        for step in sorted(steps, key=lambda s: (s[2] + rest[s[0]][s[1]], s[3]), reverse=True):
            j, to, total, edits = step
            known = best.get((j, to))
            if known is None or (total, edits) < known:
                best[j, to] = total, edits
                stack.append(step)
    return found


def illegal(rows: list[Row]) -> int:
    """Neighbouring rows whose roles may not follow one another; nothing but a beginning may precede a system turn."""
    inside = sum(r.copies - 1 for r in rows)  # no role follows itself
    return inside + sum(not _follows(a.code, b.code) for a, b in zip(rows, rows[1:]))


def _follows(a: int, b: int) -> bool:
    return (a, b) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def made(rows: list[Row], entry: int, audit: str):
    """(row, edit, role state) of every turn that the audit makes of the rows, in order."""
    state, at = entry, 0
    for i, row in enumerate(rows):
        while audit[at] == "I":
            state = NEXT[state]
            yield i, "I", state
            at += 1
        if audit[at] != "D":
            state = row.code if audit[at] == "K" else NEXT[state]
            yield i, audit[at], state
        at += row.copies
    for _ in audit[at:]:
        state = NEXT[state]
        yield len(rows) - 1, "I", state


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with made faults, by the checksum of ``conv_id:turn``; nulls of role and text become one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(role)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    twice = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("copy", F.explode(twice)).drop("kind", "copy")


def _light(rows: DataFrame) -> DataFrame:
    """The distinct rows without their texts: hashes of row and content, role code, fault, copies."""
    own = lambda *cols: F.unhex(F.sha2(F.concat(F.to_json(F.struct(*cols)), "text"), 256))
    first = F.substring("role", 1, 1)
    code = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)
    solid = F.rtrim("text", F.lit(SPACES))
    fault = F.when(solid == "", BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    out = rows.select(F.col("conv_id").alias(CONV), "turn", own("conv_id", "turn", "role").alias("rid"),
                      own("conv_id", "role").alias("did"), code.alias("code"), fault.alias("fault"))
    return out.groupBy(CONV, "turn", "rid", "did", "code", "fault").agg(F.count("*").alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """The distinct rows with their final fault and ``at``, their place among the rows of all conversations."""
    light = cut(_light(rows), "turns")
    seen = light.groupBy("did").agg(F.min("turn").alias("first"), F.max(F.isnull("turn")).alias("null_first"),
                                    F.count("*").alias("c")).where("c > 1").drop("c")
    earlier = F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("first")))
    fault = F.when((F.col("fault") != BLANK) & F.coalesce(earlier, F.lit(False)), DUPLICATE).otherwise(F.col("fault"))
    out = light.join(seen, "did", "left").select(CONV, "turn", "rid", "code", fault.alias("fault"), "copies")
    order = [F.col(CONV).asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("rid")]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(out.withColumn("at", F.monotonically_increasing_id())
               .withColumn("block", F.expr(f"at div {BLOCK}")), "ordered")


def _conversations(group: pa.Table) -> list[tuple[int, int, object, list[Row]]]:
    """(first place, first row, conversation, rows) of the conversations in a sorted block."""
    conv = group.column(CONV).to_pylist()
    at, code, fault, copies = (group.column(c).to_pylist() for c in ("at", "code", "fault", "copies"))
    out, begin = [], 0
    for i in range(1, len(conv) + 1):
        if i == len(conv) or conv[i] != conv[begin]:
            out.append((at[begin], begin, conv[begin], [Row(*r) for r in zip(code[begin:i], fault[begin:i], copies[begin:i])]))
            begin = i
    return out


def _solved(ordered: DataFrame) -> DataFrame:
    """Per conversation and block its paths (entry, exit, cost, audit), and what its neighbours need to know."""
    conv = T.StructField(CONV, ordered.schema[CONV].dataType)
    path = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()),
                         T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    schema = T.StructType([conv, T.StructField("block", T.LongType()), T.StructField("at", T.LongType()),
                           T.StructField("whole", T.BooleanType()), T.StructField("illegal", T.LongType()),
                           T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
                           T.StructField("paths", T.ArrayType(path))])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        found, out = _conversations(group), []
        for k, (at, _, conv, rows) in enumerate(found):
            whole = 0 < k < len(found) - 1  # else it may begin or end in another block
            paths, rest = [], bounds(rows)
            if whole:
                paths.append((NOTHING, NOTHING, *search(rows, rest=rest)))
            else:
                for entry in range(4):
                    for goal in range(4):
                        path = search(rows, entry, goal, rest)
                        if path:
                            paths.append((entry, goal, *path))
            out.append({CONV: conv, "block": group.column("block")[0].as_py(), "at": at, "whole": whole,
                        "illegal": illegal(rows), "first": rows[0].code, "last": rows[-1].code,
                        "paths": [dict(zip(("entry", "exit", "cost", "audit"), p)) for p in paths]})
        kinds = pa.schema([pa.field(CONV, group.schema.field(CONV).type), ("block", pa.int64()), ("at", pa.int64()),
                           ("whole", pa.bool_()), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
                           ("paths", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()),
                                                         ("cost", pa.int64()), ("audit", pa.string())])))])
        return pa.Table.from_pylist(out, kinds)

    return ordered.select(CONV, "block", "at", "code", "fault", "copies").groupBy("block").applyInArrow(run, schema)


def _chained(parts: DataFrame) -> DataFrame:
    """The least path through the blocks of each conversation that may lie in several."""
    fields = [parts.schema[c] for c in (CONV, "block", "at")]
    schema = T.StructType([*fields, T.StructField("entry", T.IntegerType()), T.StructField("piece", T.StringType()),
                           T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
                           T.StructField("illegal", T.LongType())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        rows, wrong, last = group.to_pylist(), 0, None
        # per state the best (cost, audit), and the blocks' choices as a chain
        best: dict[int, tuple[int, str, tuple | None]] = {NOTHING: (0, "", None)}
        for r in rows:
            wrong += r["illegal"] + (last is not None and not _follows(last, r["first"]))
            last, after = r["last"], {}
            for p in r["paths"]:
                if p["entry"] in best:
                    cost, audit, chain = best[p["entry"]]
                    new = cost + p["cost"], audit + p["audit"]
                    if p["exit"] not in after or new < after[p["exit"]][:2]:
                        after[p["exit"]] = *new, (p["entry"], p["audit"], chain)
            best = after
        cost, audit, tail, chain = min((c + TAIL[s][0], a + TAIL[s][1], TAIL[s][1], ch) for s, (c, a, ch) in best.items())
        entry, piece, more = [], [], chain
        while more:
            entry.append(more[0])
            piece.append(more[1])
            more = more[2]
        piece[0] += tail
        n = len(rows)
        return group.select([CONV, "block", "at"]).append_column("entry", pa.array(entry[::-1], pa.int32())) \
            .append_column("piece", pa.array(piece[::-1])) \
            .append_column("cost", pa.array([cost] + [None] * (n - 1), pa.int64())) \
            .append_column("audit", pa.array([audit] + [None] * (n - 1), pa.string())) \
            .append_column("illegal", pa.array([wrong] + [None] * (n - 1), pa.int64()))

    return parts.groupBy(CONV).applyInArrow(run, schema)


def _plan(ordered: DataFrame) -> DataFrame:
    """Per conversation and block: entry state and audit there; in the first block its cost, audit and illegal pairs."""
    parts = cut(_solved(ordered), "paths")
    whole = parts.where("whole").withColumn("p", F.col("paths")[0]) \
        .select(CONV, "block", "at", "p.entry", F.col("p.audit").alias("piece"), "p.cost", "p.audit", "illegal")
    chained = _chained(parts.where("not whole").select(CONV, "block", "at", "illegal", "first", "last", "paths"))
    return cut(whole.unionByName(chained), "plan")


def _made(ordered: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, at, k, edit, role, rid) of every turn made; role is null where the row's own stays."""
    conv = T.StructField(CONV, ordered.schema[CONV].dataType)
    schema = T.StructType([conv, T.StructField("at", T.LongType()), T.StructField("k", T.IntegerType()),
                           T.StructField("edit", T.StringType()), T.StructField("new_role", T.StringType()),
                           T.StructField("rid", T.BinaryType())])

    def run(group: pa.Table, chosen: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        how = {p["at"]: (p["entry"], p["piece"]) for p in chosen.select(["at", "entry", "piece"]).to_pylist()}
        index, k, edits, roles = [], [], [], []
        for at, begin, _, rows in _conversations(group):
            for i, edit, state in made(rows, *how[at]):
                k.append(k[-1] + 1 if index and index[-1] == begin + i else 0)
                index.append(begin + i)
                edits.append(edit)
                roles.append(None if edit == "K" else ROLE[state])
        out = group.select([CONV, "at", "rid"]).take(pa.array(index, pa.int64()))
        return pa.table([out.column(0), out.column(1), pa.array(k, pa.int32()), pa.array(edits, pa.string()),
                         pa.array(roles, pa.string()), out.column(2)], names=schema.names)

    return ordered.select(CONV, "block", "at", "code", "fault", "copies", "rid").groupBy("block") \
        .cogroup(plan.select("block", "at", "entry", "piece").groupBy("block")).applyInArrow(run, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and a report per conversation, of (conv_id, turn, role, text).

    Turns: conv_id, place and k (which order them), edit, role, text.  Report: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit; conversations without rows have none.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    ordered = _ordered(rows)
    plan = _plan(ordered)
    turns = cut(_made(ordered, plan), "made")
    rid = F.unhex(F.sha2(F.concat(F.to_json(F.struct("conv_id", "turn", "role")), "text"), 256))
    texts = rows.select(rid.alias("rid"), "role", "text").dropDuplicates(["rid"])
    own = turns.where("edit <> 'I'").join(texts, "rid").select(
        F.col(CONV).alias("conv_id"), F.col("at").alias("place"), "k", "edit",
        F.coalesce("new_role", "role").alias("role"), "text")
    inserted = turns.where("edit = 'I'").select(F.col(CONV).alias("conv_id"), F.col("at").alias("place"), "k", "edit",
                                                F.col("new_role").alias("role"), F.lit("").alias("text"))
    number = lambda c, kind: F.sum(F.when(F.col("fault") == kind, c).otherwise(0)).alias(f"n{kind}")
    again = F.sum(F.when(F.col("fault").isin(FINE, CUT_OFF), F.col("copies") - 1).otherwise(0))
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + F.lit(1) - wide(F.count_distinct("turn"))
    stats = ordered.groupBy(CONV).agg(
        gaps.alias("gaps"), number(F.col("copies"), BLANK), number(F.col("copies"), DUPLICATE), again.alias("again"),
        number(F.lit(1), CUT_OFF))
    none = lambda kind: F.lit(None).cast(kind)
    report = stats.select(CONV, F.coalesce(F.expr("try_cast(gaps as bigint)"), F.lit(0)).cast("long").alias("gaps"),
                          F.col(f"n{BLANK}").cast("long").alias("blank"),
                          (F.col(f"n{DUPLICATE}") + F.col("again")).cast("long").alias("duplicate"),
                          F.col(f"n{CUT_OFF}").cast("long").alias("truncated"),
                          none("long").alias("illegal"), none("long").alias("cost"), none("string").alias("audit")) \
        .unionByName(plan.where("audit is not null").select(
            CONV, *[none("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")], "illegal", "cost", "audit"))
    report = report.groupBy(F.col(CONV).alias("conv_id")).agg(
        *[F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])
    return own.unionByName(inserted), report


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256 of its turns' ``role:text`` lines); a task reads its conversations in order, batch by batch."""
    rows = turns.select("conv_id", "place", "k", F.concat_ws(":", "role", "text").alias("line")) \
        .repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place", "k")
    schema = T.StructType([turns.schema["conv_id"], T.StructField("sha", T.StringType())])

    def run(batches):
        conv = h = None
        for batch in batches:
            ids, shas = [], []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if h is None or c != conv:
                    if h is not None:
                        ids.append(conv)
                        shas.append(h.hexdigest())
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(line.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(shas, pa.string())],
                                             names=schema.names)
            kind = batch.schema.field(0).type
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([h.hexdigest()], pa.string())],
                                             names=schema.names)

    return rows.select("conv_id", "line").mapInArrow(run, schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def op11_turn_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    turns, report = repair(damaged(rows))
    none = lambda kind: F.lit(None).cast(kind)
    long_ = [none("long").alias(c) for c in COUNTS]
    out = rows.select("conv_id", *long_, none("string").alias("audit"), none("string").alias("sha")).distinct() \
        .unionByName(report.withColumn("sha", none("string"))) \
        .unionByName(digests(turns).select("conv_id", *long_, none("string").alias("audit"), "sha"))
    # a group of three rows at most; null ids are a group as well
    return out.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in COUNTS],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
