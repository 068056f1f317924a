import random
import re

import pytest

from aidlake.llm import substrings

SCHEMA = "doc_id long, text string, kept string, chunk int"
BIG = 1 << 70


def brute(rows, n):
    """As in the definition, over all windows."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    own = {}
    for (i, *_), w in zip(rows, split):
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            own[key] = min(own.get(key, BIG), BIG if i is None else i)
    out = []
    for (i, *_), w in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if own[tuple(w[k : k + n])] < (BIG if i is None else i):
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,chunk", [(13, 2 << 20), (13, 500), (5, 300), (30, 2_000)])
def test_against_brute_force(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    r = random.Random(window + chunk)
    passages = [[f"p{k}w{i}" for i in range(r.randrange(window - 2, 4 * window))] for k in range(8)]
    rows = []
    for i in range(120):
        words = [f"u{r.randrange(60)}" for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            words[len(words) // 2 : len(words) // 2] = r.choice(passages)
        rows.append((i * 3 - 50, " ".join(words), None, 0))
    rows += [(1000 + i, rows[7][1], "k", 1) for i in range(40)] + [(5, "b\x1cc A a " * 40, None, None), (2000, "b\x1cc A a " * 40, None, None)]
    rows += [(None, rows[7][1], None, None), (None, None, None, None), (3000, None, None, None), (3001, "", None, None), (4, rows[9][1], None, 1), (4, rows[9][1], None, 1)]
    r.shuffle(rows)
    got = substrings.substring_dedup(spark.createDataFrame(rows, SCHEMA), window=window).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_removed, g.kept.decode()) for g in got), key=str) == brute(rows, window)


def test_empty_table(spark):
    assert substrings.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_levels_double():
    for w in (1, 4, 7, 8, 13, 50, 100):
        plan = substrings.levels(w)
        assert plan[-1] == w and all(b <= 2 * a for a, b in zip(plan, plan[1:]))
        assert plan[0] <= 7


def test_three_levels_and_what_they_leave(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 100)
    assert substrings.levels(13) == [4, 7, 13]
    r, trace = random.Random(2), []
    shared = " ".join(f"s{i}" for i in range(30))
    half = [" ".join(f"h{k}x{i}" for i in range(6)) for k in range(20)]  # repeats of six words only
    rows = [(i, " ".join([*(f"u{i}x{j}" for j in range(40)), half[i % 20], *(f"v{i}x{j}" for j in range(20)), shared if i in (3, 9) else "end"])) for i in range(60)]
    got = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), trace=trace).collect()
    assert {g.doc_id: g.n_removed for g in got} == {i: 30 if i == 9 else 0 for i in range(60)}
    assert [t[0] for t in trace] == [4, 7, 13] and trace[0][2] > trace[1][2] > 0 and trace[2][2] == 18
    assert trace[1][1] < trace[0][1] / 2 and 36 <= trace[2][1] < 60


def test_long_texts_and_words(spark, monkeypatch):
    """Texts longer than a chunk and a block, words longer than a block; hashes do not depend on where a word is."""
    r = random.Random(3)
    monkeypatch.setattr(substrings, "BLOCK", 64)
    monkeypatch.setattr(substrings, "CHUNK", 1_000)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(3_000))
    rows = [(1, long, "", 0), (2, "x" * 500 + " \t" + long[100:9_000] + "\x0b é", "", 0), (3, " " + long[50:] + " ", "", 0), (4, "y" * 70 + " z", "", 0)]
    got = substrings.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_removed, g.kept.decode()) for g in got), key=str) == brute(rows, 13)


def test_a_text_longer_than_a_chunk_at_the_real_size(spark):
    words = [f"w{i}" for i in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:1050]) + " tail")]
    got = {g.doc_id: g for g in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed, got[2].kept) == (400_000, 0, 50, b"tail")
