import hashlib
import itertools
import random
import re
import time
import zlib

from helpers_llm import frame
from shelfwise.llm import turn_repair as t

SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """Of (role, text) in order: b, d, t or nothing."""
    seen, out = set(), []
    for row in rows:
        solid = SOLID.findall(row[1])
        out.append("b" if not solid else "d" if row in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add(row)
    return out


def best(rows, found):
    """The least (cost, audit, made) over the rows one by one: a table of all prefixes by last role."""
    def inserted(table):
        for _ in range(2):
            for state, new in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                if state in table:
                    c, e, m = table[state]
                    way = (c + 5, e + "I", m + [("user" if new == "u" else "assistant", "")])
                    table[new] = min(table.get(new, way), way, key=lambda w: w[:2])
        return table

    table = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, found):
        after = {}
        for state, (c, e, m) in table.items():
            ways = [(state, c + 2, e + "D", m)]
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                for new in "sua":
                    if new == "s" and state == "" or new == "u" and state in ("", "s", "a") or new == "a" and state == "u":
                        if role[:1] == new:
                            ways.append((new, c + more, e + "K", [*m, (role, text)]))
                        if new != "s":
                            ways.append((new, c + more + 1, e + "R", [*m, ("user" if new == "u" else "assistant", text)]))
            for new, *way in ways:
                after[new] = min(after.get(new, tuple(way)), tuple(way), key=lambda w: w[:2])
        table = inserted(after)
    return min((table[s] for s in ("", "a") if s in table), key=lambda w: w[:2])


def brute(rows):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    left = damage(rows)
    for c in {r[0] for r in left}:
        own = sorted((r for r in left if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [(r[2], r[3]) for r in own]
        found = faults(pairs)
        cost, audit, made = best(pairs, found)
        wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        lines = "\n".join(f"{r}:{x}" for r, x in made)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("b"), found.count("d"),
                  found.count("t"), wrong, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def query(spark, rows, tmp_path):
    # several files of a table beside one another, extra columns with names of the operator's own
    path = str(tmp_path / "conversations.parquet")
    frame(spark, [(*r, 7, "x") for r in rows], SCHEMA + ", at long, audit string").repartition(3).write.parquet(path)
    return {r["conv_id"]: tuple(r[c] for c in (*t.COUNTS, "audit", "repaired_sha256"))
            for r in t.op11_turn_repair(spark, str(tmp_path)).collect()}


def made_up(seed, conversations, longest=12):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        n = rng.choice([1, 2, 5, longest])
        for k in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < .3 else ["user", "assistant"][k % 2]
            role = "system" if k == 0 and rng.random() < .4 or rng.random() < .05 else role
            role = rng.choice([None, "", "tool", "Usher"]) if rng.random() < .05 else role
            text = rng.choice(["Well done.", "no stop", " \n", None, f"Line {rng.randrange(99)}!", "é?\x0b ", "so\n"])
            rows.append((c, k * rng.choice([1, 1, 1, 2]), role, text))
    return list(dict.fromkeys(rows))


def untied(rows):
    """One row of each turn, so that the order is defined by the turn."""
    return list({(r[0], r[1]): r for r in rows}.values())


def test_search_against_enumeration():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", ""])) for _ in range(rng.randrange(4))]
        found = faults(rows)
        ways = []
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(f in ("b", "d") and e != "D" for f, e in zip(found, edits)):
                continue
            for places in itertools.chain.from_iterable(
                    itertools.combinations_with_replacement(range(len(rows) + 1), k) for k in range(3)):
                audit, slots, cost = "", "", 5 * len(places)
                for i in range(len(rows) + 1):
                    audit += "I" * places.count(i)
                    slots += "?" * places.count(i)
                    if i < len(rows):
                        audit += edits[i]
                        slots += {"D": "", "K": rows[i][0][0], "R": "?"}[edits[i]]
                        cost += {"D": 2, "K": 0, "R": 1}[edits[i]] + (5 if found[i] == "t" and edits[i] != "D" else 0)
                n = len(slots)
                for goal in {"", "ua" * (n // 2), "s" + "ua" * (n // 2)}:
                    # what is not kept becomes user or assistant
                    if len(goal) == n and goal != "s" and all(x == y or x == "?" and y != "s" for x, y in zip(slots, goal)):
                        ways.append((cost, audit))
        codes = {"s": t.SYSTEM, "u": t.USER, "a": t.ASSISTANT}
        kinds = {"": t.FINE, "b": t.BLANK, "d": t.DUPLICATE, "t": t.CUT_OFF}
        assert t.search([t.Row(codes.get(r[0][0], 0), kinds[f], 1) for r, f in zip(rows, found)]) == min(ways)
        assert best(rows, found)[:2] == min(ways)


def test_query_against_brute_force(spark, tmp_path):
    rows = untied(made_up(1, 150)) + [(None, k, r, x) for k, (r, x) in enumerate(
        [("user", "Hi."), ("user", "Ho."), ("assistant", "cut"), (None, None)])]
    rows += [(500, None, "user", "One."), (500, 7, "user", "One."), (500, 9, "assistant", "Two."), (501, 3, "user", None)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_long_conversations_in_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 8)
    rows = untied(made_up(2, 25, 90))
    rows += [(900, k, ["user", "assistant"][k % 2], f"T{k}.") for k in range(300)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_repeated_rows_and_an_empty_table(spark, tmp_path):
    rows = [(1, 0, "user", "A."), (1, 1, "assistant", "B.")] * 3 + [(2, 0, "user", " ")] * 4
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert query(spark, rows, tmp_path / "a") == brute(rows)
    assert query(spark, [], tmp_path / "b") == {}


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "tool", "B."), (1, 3, "assistant", "C.")]
    turns, report = t.repair(frame(spark, rows, SCHEMA))
    got = [(r["edit"], r["role"], r["text"]) for r in turns.orderBy("conv_id", "place", "k").collect()]
    audit = report.collect()[0]["audit"]
    assert "".join(e for e, _, _ in got) == audit.replace("D", "")
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in got))


def test_search_of_hard_blocks_ends_soon():
    rng = random.Random(9)
    began = time.time()
    for weights in ((1, 1, 1, 1), (0, 1, 1, 0), (3, 1, 1, 3), (0, 1, 0, 0)):
        rows = [t.Row(rng.choices(range(4), weights)[0], rng.choice([0, 0, 0, 3]), 1) for _ in range(t.BLOCK)]
        for entry in range(4):
            t.search(rows, entry)
    assert time.time() - began < 60
