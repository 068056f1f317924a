import random

import numpy as np

from aidlake.llm import common


def test_components_of_random_graphs(spark):
    r = random.Random(5)
    for n, m in ((60, 45), (200, 150), (120, 119)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if m != n - 1 else [(i, i + 1) for i in range(m)]  # the last one is a path
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: root[x] for x in linked if root[x] != x}
    assert common.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_spanning_joins_the_same_nodes():
    r = np.random.default_rng(0)
    u, v = r.integers(0, 300, 250).astype(np.uint64), r.integers(0, 300, 250).astype(np.uint64)
    a, b = common.spanning(u, v)
    assert len(a) == len(set(a.tolist()))

    def roots(x, y):
        root = list(range(300))
        for _ in range(300):
            for p, q in zip(x.tolist(), y.tolist()):
                root[p] = root[q] = min(root[p], root[q])
        return root

    assert roots(u, v) == roots(a, b)


def test_blobs_and_shards():
    r = np.random.default_rng(1)
    a = np.sort(r.integers(0, 2**64, 5_000, dtype=np.uint64))
    assert (common.unpack(common.pack(a)) == a).all()
    assert (common.unpack_plain(common.pack_plain(a), np.uint64) == a).all()
    at = common.shard_bounds(a, 7)
    assert at[0] == 0 and at[-1] == len(a) and (np.diff(at) > 500).all()
    assert common.contains(a, np.array([a[3], a[3] + np.uint64(1)])).tolist() == [True, bool(a[4] == a[3] + 1)]
    assert common.contains(a[:0], a).sum() == 0


def test_windows_hash_alike_wherever_they_are():
    w = np.random.default_rng(2).integers(0, 2**64, 50, dtype=np.uint64)
    assert (common.window_hashes(w, 5)[10:] == common.window_hashes(w[10:], 5)).all()
    assert len(common.window_hashes(w[:3], 5)) == 0


def test_word_hashes_forget_beyond_their_bound():
    c = common.WordHashes(most=3)
    before = c.of([b"a", b"b", b"c", b"d", b"e"])
    assert len(c) <= 3 and (c.of([b"a", b"b", b"c", b"d", b"e"]) == before).all()
