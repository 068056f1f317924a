import numpy as np

from aidlake.llm import grid_order

SCHEMA = "vec_id long, embedding array<float>, label int, key string, class long"


def brute(rows, t):
    ids = [r[0] for r in rows]
    ok = []
    for _, v, label, *_ in rows:
        x = None if v is None or any(e is None for e in v) else np.array(v, np.float32).astype(float)
        ok.append(x if label is not None and x is not None and np.isfinite(x).all() and len(x) and np.linalg.norm(x) > 0 else None)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                link[i, j] = ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= t
    comp = list(ids)
    for _ in range(n):
        for i in range(n):
            for j in np.flatnonzero(link[i]):
                comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (int(link[k].sum()), comp[k]) for k, i in enumerate(ids)}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(grid_order, "BLOCK", 8)  # many blocks, several levels of intervals
    r = np.random.default_rng(3)
    rows = []
    for c in range(25):
        center = r.normal(size=12)
        for _ in range(int(r.integers(1, 14))):
            v = center + r.normal(size=12) * r.choice([0.02, 0.1, 0.2]) * np.linalg.norm(center) / 3.4
            rows.append([len(rows), [float(x) for x in v.astype(np.float32) * r.choice([1, 5])], int(c % 3), "k", 1])
    rows += [[len(rows) + i, rows[0][1], rows[0][2], "k", 1] for i in range(20)]  # copies
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0] * 12, [1.0] * 5, [1.0] * 5]
    rows += [[1000 + i, v, 0 if i != 6 else None, None, None] for i, v in enumerate(odd)]
    got = {g.vec_id: (g.n_links, g.component_id) for g in grid_order.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows, 0.98)
    assert got == want
    assert sum(n for n, _ in want.values()) > 400


def test_skips_distant_blocks(spark, monkeypatch):
    monkeypatch.setattr(grid_order, "BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] * 3 + r.normal(size=8) * 0.01], 0) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    classes = grid_order.usable(df).selectExpr("key", "label", "vec", "1L as n", "id as class")
    axes = grid_order.principal(classes)
    cut = grid_order.blocks(classes, axes, 0.2, 4)
    n, pairs = cut.count(), grid_order.near_blocks(cut.drop("classes", "counts", "vecs"), axes.shape[1] + 1, 0.2).count()
    assert pairs < n * (n + 1) / 2 / 4


def test_repeats_nulls_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0, "", 0), (1, [1.0, 0.0], 0, "", 0), (None, [1.0, 0.0], 0, "", 0), (None, None, None, None, None)]
    got = sorted(((g.vec_id, g.n_links, g.component_id, g.kept) for g in grid_order.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=str)
    assert grid_order.embedding_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clustered_vectors_meet_few_blocks(spark):
    """Two hundred clusters under one label: a fifth of all pairs of blocks at most is compared."""
    r, trace = np.random.default_rng(6), []
    centers = r.normal(size=(200, 32))
    rows = [(i, [float(x) for x in centers[i % 200] + r.normal(size=32) * 0.02], 0) for i in range(6_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = grid_order.embedding_groups(df, trace=trace).collect()
    (n, met), = trace
    assert met <= n * (n + 1) / 2 / 5, trace
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T) >= 0.98).sum(1) - 1
    assert [g.n_links for g in sorted(got)] == want.tolist()


def test_very_long_very_large_and_very_small_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 0.0]), (5, [1.0, 0.0]), (6, [0.0] * 20_000 + [1.0]), (7, [0.0] * 20_000 + [2.0])]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, `key` string, `a.class` string")
    got = {g.vec_id: (g.n_links, g.component_id) for g in grid_order.embedding_groups(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}
