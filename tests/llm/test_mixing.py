import random

from helpers_llm import doc, frame, prose, words
from shelfwise.llm import mixing as m


def brute_targets(sizes, weights, cap=3):
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**share, **capped}
        for s in over:
            capped[s] = cap * sizes[s]


def corpus():
    rng = random.Random(3)
    sources = ["b", "a", None, "", "é", "Z", "big", "tiny"]
    rows = []
    for k in range(400):
        src = "big" if k % 3 == 0 else sources[rng.randrange(len(sources))]
        rows.append(doc(k, prose(k, rng.choice([0, 1, 20, 300, 900])), source="tiny" if k in (1, 2) else src))
    rows += [doc(900, None, source="b"), doc(901, "", source="empty"), doc(902, None, source=None),
             doc(903, prose(9, 50), source="one"), doc(903, prose(9, 50), source="one")]
    return rows


def test_targets_and_amounts(spark):
    rows = corpus()
    got = m.mix(frame(spark, rows), shard_words=2000).collect()
    assert len(got) == len(rows)
    source, size = {}, {}
    for i, text, _, s, _ in rows:
        source[i] = s
        size[s] = size.get(s, 0) + len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = brute_targets(size, {s: 1 + k % 3 for k, s in enumerate(order)})
    taken = dict.fromkeys(size, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["passes"] * r["size"] + sum(x["to"] - x["from"] for x in r["spans"])
        assert all(0 <= x["from"] < x["to"] <= r["size"] for x in r["spans"])
        taken[s] += r["taken"]
    total = sum(size.values())
    assert abs(sum(taken.values()) - total) <= 2 * m.BLOCK_WORDS * len(size)
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 3 * m.BLOCK_WORDS


def test_reruns_agree_on_any_layout(spark):
    rows = corpus()
    a = sorted(map(str, m.mix(frame(spark, rows), shard_words=3000).collect()))
    b = sorted(map(str, m.mix(frame(spark, rows[::-1]).repartition(7), shard_words=3000).collect()))
    assert a == b


def test_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 23.0}
    units = spark.createDataFrame(list(votes.items()), "unit string, target double")
    for seats in (0, 1, 7, 10, 100):
        quotients = sorted(((-v / (2 * k + 1), u) for u, v in votes.items() for k in range(200) if v), key=lambda x: x)
        want = dict.fromkeys(votes, 0)
        for _, u in quotients[:seats]:
            want[u] += 1
        got = {r["unit"]: r["seats"] for r in m.apportion(units, seats).collect()}
        assert got == want, seats


def test_empty(spark):
    assert m.mix(frame(spark, [])).collect() == []
    got = m.mix(frame(spark, [doc(1, None), doc(2, "", source=None)])).collect()
    assert [r["taken"] for r in got] == [0, 0]


def test_shards_stay_bounded(spark, monkeypatch):
    seen, apportion = [], m.apportion

    def spied(units, seats, *args, **kwargs):
        seen.extend(r["unit_size"] for r in units.collect())
        return apportion(units, seats, *args, **kwargs)

    monkeypatch.setattr(m, "apportion", spied)
    rows = [doc(None, prose(k, 20)) for k in range(400)] + [doc(k, (None, "", " \n")[k % 3], source="blank") for k in range(90)]
    for carry in ((), ("text",)):
        seen.clear()
        out = m.mix(frame(spark, rows), shard_words=1000, carry=carry)
        assert max(seen) <= 4000 and sum(seen) == 8000
        # rows without words don't go through the window
        lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        top = next(k for k, x in enumerate(lines) if "Window [" in x and "size#" in x)
        end = next((k for k in range(top + 1, len(lines)) if depth(lines[k]) <= depth(lines[top])), len(lines))
        filters = [x for x in lines[top:end] if "Filter" in x and ("> 0)" in x or "RLIKE" in x)]
        assert filters  # rows that occur again come from a written table, which has none without words either
        got = out.collect()
        assert len(got) == 490 and sum(r["taken"] for r in got) == 8000
        assert sum(r["size"] == 0 and r["taken"] == 0 and not r["spans"] for r in got) == 90


def test_equal_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(m, "_RUN", 64)
    seen, apportion = [], m.apportion

    def spied(units, seats, *args, **kwargs):
        seen.extend(r["unit_size"] for r in units.collect())
        return apportion(units, seats, *args, **kwargs)

    monkeypatch.setattr(m, "apportion", spied)
    text = prose(1, 50)
    # equal rows, of which some differ in a column that isn't part of the key, and others
    rows = [doc(1, text)] * 700 + [doc(1, text, lang="de")] * 300 + [doc(None, text)] * 200 + [doc(2, None)] * 70 \
        + [doc(k, prose(k, 30), source="t") for k in range(3, 60)]
    for carry in ((), ("doc_id", "lang", "text")):
        seen.clear()
        got = m.mix(frame(spark, rows), shard_words=1000, carry=carry).collect()
        assert len(got) == len(rows) and sum(seen) == 1200 * 50 + 57 * 30 and max(seen) <= 4000
        assert sum(r["size"] == 0 for r in got) == 70
        per = {s: sum(r["taken"] for r in got if r["source_size"] == s) for s in (60000, 1710)}
        assert all(abs(per[s] - next(r["target"] for r in got if r["source_size"] == s)) < 0.02 * s + 100 for s in per)
        if carry:
            langs = [r["row"]["lang"] for r in got]
            assert (langs.count("de"), langs.count("en")) == (300, len(rows) - 300)
            assert all(r["row"]["doc_id"] == r["doc_id"] for r in got)
            again = m.mix(frame(spark, rows[::-1]).repartition(5), shard_words=1000, carry=carry).collect()
            assert sorted(map(str, got)) == sorted(map(str, again))


def test_clashing_columns(spark):
    rows = corpus()[:60]
    names = ("copy", "n", "begin", "unit", "order", "row", "hash", "quota", "name", "size", "target")
    extra = frame(spark, rows).selectExpr("*", *[f"'x' as {c}" for c in names])
    for carry in ((), ("doc_id", "text", "copy")):
        a = m.mix(extra, shard_words=2000, carry=carry).drop("row").collect()
        assert sorted(map(str, a)) == sorted(map(str, m.mix(frame(spark, rows), shard_words=2000).collect()))
