import random
import re

import numpy as np
import pytest
import xxhash

from aidlake.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"  # clashing names on purpose


def brute(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grouped(fps, distance):
    """{doc: smallest doc reachable} over all pairs."""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_against_all_pairs(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(words, k=r.choice([0, 1, 2, 3, 5, 80, 200]))) for _ in range(60)]
    texts = base + [re.sub(r"w\d+", lambda m: r.choice(words) if r.random() < 0.02 else m[0], t) for t in base * 3] + ["", None, "A B\x1c c", "\t\x0b \r\n"]
    rows = [(i, t, "x", 9) for i, t in enumerate(texts)]
    for distance in (0, 2, 4, 8):
        got = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA), distance=distance).collect()
        fps = {i: brute(t, 4) for i, t, *_ in rows}
        assert {g.doc_id: g.fingerprint for g in got} == {i: f"{f:016x}" for i, f in fps.items()}
        assert {g.doc_id: g.component_id for g in got} == grouped(fps, distance)
        assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_hot_keys_meet_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 7)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    r = random.Random(2)
    fps = [r.getrandbits(64)]
    while len(fps) < 300:  # a chain of near fingerprints with many equal segments
        fps.append(r.choice(fps) ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20)))
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4).collect()
    near = {(a, b) for a in fps for b in fps if a > b and (a ^ b).bit_count() <= 4}
    unsigned = [(e.u % (1 << 64), e.v % (1 << 64)) for e in edges]
    want, got = grouped(dict(zip(fps, fps)), 4), {f: f for f in fps}
    for _ in fps:  # labels by repeated relaxation over the links found
        for u, v in unsigned:
            got[u] = got[v] = min(got[u], got[v])
    assert got == want and near


@pytest.mark.parametrize("n", [1, 1_000, 10**6, 10**9, 10**11])
@pytest.mark.parametrize("distance", [1, 4, 8])
def test_segments_cover_and_suffice(n, distance):
    parts = simhash.segments(n, distance)
    assert sum(b for _, b, _ in parts) == 64 and sum(r + 1 for *_, r in parts) == distance + 1


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e", None, None), (5, "a b c d e", "f", 1), (5, "a b c d e", "f", 1), (None, "q " * 50, None, None), (None, None, None, None)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and sum(g.kept for g in got) == 4  # the two equal rows are marked alike
    assert [g.component_id for g in got if g.doc_id == 5] == [5, 5]
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_is_hashed_in_blocks():
    words = [f"w{i % 997}" for i in range(70_000)]
    text = " ".join(words)
    assert simhash.fingerprint(text.encode(), 4) == _direct(words)


def _direct(words):
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
