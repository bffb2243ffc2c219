import random
import re

from shelfwise.llm import quotations as q

SCHEMA = "conv_id long, turn long, role string, text string, thread string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return q.link_quotations(df).collect()


def test_nested_quotes(spark):
    rows = [(1, 0, "u", "Hello there\nHow are you?\n\nSecond para line one\nline two"),
            (1, 1, "a", "On Monday u wrote:\n> How are you?\nFine, thanks."),
            (1, 2, "u", ">> How are you?\n> Fine,   thanks.\n\nGreat"),
            (1, 3, "a", "> second para LINE one line two\nYes"),
            (1, 4, "x", None), (1, 5, "x", "> nothing known"), (1, 6, "u", ">Great\n>\n> Yes\nboth"),
            (2, 7, "u", "> Great"), (None, 1, "u", "> Great"), (3, None, "u", "> Great"), (1, 0, "u", "")]
    got = {(r["conv_id"], r["turn"], r["text"]): r for r in run(spark, rows)}
    assert len(got) == len(rows)
    one = lambda c, t, x: (got[c, t, x]["reply_to"], got[c, t, x]["thread"], got[c, t, x]["depth"])
    assert one(1, 1, "Fine, thanks.") == (0, 0, 1)
    assert one(1, 2, "Great") == (1, 0, 2)
    assert [tuple(x) for x in got[1, 2, "Great"]["quoted"]] == [(1, 1), (2, 0)]
    assert one(1, 3, "Yes") == (0, 0, 1)
    assert one(1, 4, "") == (None, 4, 0) and one(1, 5, "") == (None, 5, 0)
    assert one(1, 6, "both") == (2, 0, 3)  # the longer quotation decides
    assert one(2, 7, "") == (None, 7, 0) and one(None, 1, "")[0] is None and one(3, None, "")[0] is None


def test_latest_earlier_message_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(q, "BUCKET", 4)
    rows = []
    for t in range(40):
        rows.append((1, t, "u", "same line" if t % 9 == 0 else f"> same line\nreply {t}"))
    got = {r["turn"]: r for r in run(spark, rows + rows)}
    for t in range(40):
        assert got[t]["reply_to"] == (None if t % 9 == 0 else t // 9 * 9), t


def test_long_chain(spark):
    rows = [(5, 0, "u", "start line 0")] + [(5, t, "u", f"> start line {t - 1}\nstart line {t}") for t in range(1, 50)]
    got = {r["turn"]: r for r in run(spark, rows)}
    assert all(got[t]["thread"] == 0 and got[t]["depth"] == t and got[t]["text"] == f"start line {t}" for t in range(50))


def test_empty(spark):
    assert run(spark, []) == []
    assert q.conversations(q.link_quotations(spark.createDataFrame([], SCHEMA))).collect() == []


def lines(text):
    out = []
    for line in re.split("\r?\n", text or ""):
        m = re.match(r"(?:[ \t]*>)+", line)
        out.append((m[0].count(">"), re.sub(r"^[ \t]", "", line[m.end():])) if m else (0, line))
    return out


def units(body):
    parts = [body, *re.split(r"\n\s*\n", body), *body.split("\n")]
    return {u for u in (re.sub(r"\s+", " ", p.lower()).strip() for p in parts) if u}


def brute(rows):
    """{(conv, turn, role, text as given): (own text, reply_to, thread, depth)}, one message after another."""
    own, quotes = {}, {}
    for row in rows:
        ls = lines(row[3])
        says = lambda k: ls[k][1].lower().endswith("wrote:") and k + 1 < len(ls) and ls[k + 1][0] > 0
        own[row] = "\n".join(x for k, (n, x) in enumerate(ls) if not n and not says(k)).strip(" \t\r\n")
        runs = []
        for level, body in ls:
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        quotes[row] = [(n, "\n".join(b)) for n, b in runs if n and "\n".join(b)]
    reply = {}
    for row in rows:
        votes = {}
        for level, body in quotes[row]:
            for u in units(body):
                before = [r[1] for r in rows if None not in (row[0], row[1], r[1]) and r[0] == row[0] and r[1] < row[1]
                          and u in units(own[r])]
                if before:
                    key = level, max(before)
                    votes[key] = votes.get(key, 0) + len(u)
        reply[row] = max(((-n, v, to) for (n, to), v in votes.items()), default=(0, 0, None))[2]
    up = {}
    for row in rows:
        if reply[row] is not None:
            up[row[:2]] = min(reply[row], up.get(row[:2], reply[row]))
    out = {}
    for row in rows:
        thread, depth = row[1], 0
        while reply[row] is not None and (row[0], thread) in up:
            thread, depth = up[row[0], thread], depth + 1
        out[row] = own[row], reply[row], thread, depth
    return out


def chats(seed):
    """Messages that quote earlier ones, what these quote as well, one level deeper, in parts and with other blanks."""
    rng, rows = random.Random(seed), []
    for conv in range(6):
        said = []
        for turn in range(rng.randrange(2, 14)):
            text = []
            for _ in range(rng.randrange(3) if said else 0):
                quoted = rng.choice(said).split("\n")
                quoted = quoted[rng.randrange(len(quoted)):] if rng.random() < .5 else quoted
                if rng.random() < .5:
                    text.append("Someone wrote:")
                text += [rng.choice(("> ", ">", " >")) + (x.upper() if rng.random() < .2 else x) for x in quoted]
            for _ in range(rng.randrange(4)):
                text.append("" if rng.random() < .3 else " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 4))))
            said.append("\n".join(text))
            rows.append((conv, turn, rng.choice("ua"), said[-1]))
            if rng.random() < .15:  # another message of this turn
                rows.append((conv, turn, "x", "> " + rng.choice(said).replace("\n", "\n> ")))
    return rows + [(None, 1, "u", "> w1"), (3, None, "u", "> w1\nlast"), (4, 5, "u", None)]


def test_brute_force(spark):
    replies = deep = 0
    for seed in range(3):
        rows = list(dict.fromkeys(chats(seed)))
        want = brute(rows)
        df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
        key = lambda r: tuple(map(str, r))
        got = sorted((key((r["conv_id"], r["turn"], r["role"], r["text"], r["reply_to"], r["thread"], r["depth"]))
                      for r in q.link_quotations(df).collect()))
        assert got == sorted(key((*r[:3], *want[r])) for r in rows)
        replies += sum(w[1] is not None for w in want.values())
        deep = max(deep, *(w[3] for w in want.values()))
    assert replies > 40 and deep >= 3


def test_conversations_are_in_reply_order(spark):
    rows = chats(7) + [(9, t, "u", "again") for t in range(30)] + [(9, 3, "u", "again")] * 5 + [(None, 1, "u", "> w1")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", place long")
    linked = q.link_quotations(df)
    for layout in (linked, linked.repartition(7)):
        got = q.conversations(layout, part=4).collect()
        built = {}
        for r in sorted(got, key=lambda r: r["part"]):
            assert r["n_messages"] == len(r["messages"]) <= 4
            if r["conv_id"] is None:
                assert r["part"] == 0 and r["n_messages"] == 1
            else:
                built.setdefault(r["conv_id"], []).extend(r["messages"])
        assert sum(r["n_messages"] for r in got) == len(rows) and sum(r["conv_id"] is None for r in got) == 2
        for conv, messages in built.items():
            assert [m["place"] for m in messages] == list(range(sum(r[0] == conv for r in rows)))
            order = [(m["thread"], m["turn"]) for m in messages if m["turn"] is not None]
            assert order == sorted(order)
            assert all(m["turn"] is not None for m in messages[:len(order)])
            seen = set()
            for m in messages:
                assert m["reply_to"] is None or m["reply_to"] in seen
                seen.add(m["turn"])
