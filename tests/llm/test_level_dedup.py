import hashlib
import random

from helpers_llm import doc, frame, prose, words
from shelfwise.llm import level_dedup as s


def brute(rows, window):
    first, out = {}, []
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng, rows = random.Random(9), []
    shared = [prose(100 + k, n) for k, n in enumerate((49, 50, 51, 75, 130, 400))]
    for k in range(60):
        parts = [prose(k, rng.choice([0, 3, 40, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            w = shared[rng.randrange(len(shared))].split()
            a = rng.choice([0, 0, 5])
            parts += [" ".join(w[a:]), prose(1000 + rng.randrange(9999), rng.choice([0, 1, 20]))]
        rows.append(doc((k * 37) % 101, "\n".join(parts)))
    rows += [doc(200, rows[3][1]), doc(201, rows[3][1].replace("\n", "  ")), doc(202, None), doc(203, ""),
             doc(204, "a " * 120), doc(205, "a " * 60), doc(206, "é   " * 80), doc(207, prose(100, 49) + " x"),
             doc(None, rows[3][1]), doc(208, prose(3, 30000)), doc(209, prose(3, 29000))]
    return rows


def result(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    assert result(s.substring_dedup(frame(spark, rows))) == brute(rows, 50)


def test_other_windows_and_repeated_ids(spark):
    rows = corpus()
    rows += [rows[5], rows[7], doc(rows[8][0], rows[9][1]), doc(rows[9][0], prose(5, 70))]
    for window in (7, 20):
        assert result(s.substring_dedup(frame(spark, rows), window=window)) == brute(rows, window)


def test_kept_text(spark):
    a, b = prose(1, 60), prose(2, 20)
    rows = [doc(1, a), doc(2, f"{b}\n\n{a}\nend"), doc(3, a), doc(4, b)]
    got = {r["doc_id"]: r["kept_text"] for r in s.substring_dedup(frame(spark, rows), with_text=True).collect()}
    assert got == {1: None, 2: f"{b}\nend", 3: "", 4: None}


def test_empty_table_and_no_repeats(spark):
    assert s.substring_dedup(frame(spark, [])).collect() == []
    rows = [doc(1, prose(1, 70)), doc(2, prose(2, 70))]
    assert result(s.substring_dedup(frame(spark, rows))) == brute(rows, 50)


def test_longest_repeats(spark):
    a = prose(1, 230)
    rows = [doc(1, a + " x " + prose(2, 10)), doc(2, prose(3, 30) + " " + a)]
    got = {(r["doc_id"], r["start"]): r["length"] for r in s.longest_repeats(frame(spark, rows)).collect()}
    want = {}
    for i, at in ((1, 0), (2, 30)):
        for k in range(230 - 50 + 1):
            want[i, at + k] = max(n for n in (50, 100, 200) if k + n <= 230)
    assert got == want


def test_longest_repeats_of_exact_copies(spark):
    text = prose(301, 230)
    rows = [doc(1, text), doc(2, text), doc(3, prose(302, 230)), doc(4, prose(303, 60)), doc(4, prose(303, 60))]
    got = sorted((r["doc_id"], r["start"], r["length"]) for r in s.longest_repeats(frame(spark, rows)).collect())
    assert got == [(i, k, 200 if k <= 30 else 100 if k <= 130 else 50) for i in (1, 2) for k in range(181)]


def test_many_rows_of_one_id_are_read_once_each(spark, monkeypatch):
    shared, seen, last = prose(1, 60), [], s._last_pass
    monkeypatch.setattr(s, "_last_pass", lambda texts, *a: (seen.append(texts.count()), last(texts, *a))[1])
    rows = [doc(1, shared)] + [doc(2, f"{prose(k, 20)} {shared}") for k in range(2, 42)] * 2
    got = s.substring_dedup(frame(spark, rows)).where("doc_id = 2").collect()
    assert seen == [80] and len(got) == 80 and all(r["n_removed"] == 60 for r in got)
