import hashlib

import numpy as np
import pytest

from aidlake.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, x array<int>, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd in Python's integers."""
    good = [(i, [int(np.floor(4096 * float(np.float32(c)))) for c in v], lab) for i, v, lab, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    good.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not good:
        return []
    d = len(good[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, v, _ in good:
                mine[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else c for m, c in zip(mine, books[p], strict=True)]
    out, sums = [], {}
    for i, v, lab in good:
        near = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in near), sum(s for s, _ in near), lab))
        sums[lab] = sums.get(lab, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, sums[lab], sha) for i, c, e, lab in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_lloyd(spark, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, 32))
    rows = [(i * 3 % 1000, [float(x) for x in (centres[i % 30] + r.normal(size=32) * 0.3).astype(np.float32)], [None, 1, 2][i % 3], [1], "c") for i in range(400)]
    trace = []
    assert got(vc.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5), trace=trace)) == brute(rows)
    assert trace[0] >= 400 * 8 * 16 and trace[-1] < 0.8 * 400 * 8 * 16, trace  # bounds save distances


def test_ties_repeats_and_coarse_values(spark):
    """Components of few values make many equal distances."""
    r = np.random.default_rng(3)
    rows = [(i // 2, [float(x) / 4096 for x in r.integers(-2, 3, 16)], 0, None, None) for i in range(300)]
    rows += [(7, rows[0][1], 0, None, None)] * 40 + [(None, rows[1][1], None, None, None)]
    assert got(vc.vector_codes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_what_is_left_out(spark):
    odd = [None, [], [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 9]
    rows = [(100 + i, v, 1, None, None) for i, v in enumerate(odd)] + [(i, [float(i)] * 8, 1, None, None) for i in range(5)]
    assert got(vc.vector_codes(spark.createDataFrame(rows, SCHEMA))) == brute([x for x in rows if x[1] is not None and len(x[1]) != 9])
    assert vc.vector_codes(spark.createDataFrame(rows[:6], SCHEMA)).collect() == []
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    other = rows[6:] + [(50, [1.0] * 16, 1, None, None)]
    assert got(vc.vector_codes(spark.createDataFrame(other, SCHEMA))) == brute(rows[6:])


def test_bounds_hold_after_every_step():
    r = np.random.default_rng(5)
    x, books = r.integers(-50, 50, (500, 4)), r.integers(-50, 50, (16, 4))
    group = vc.grouped(books)
    at, low = np.zeros(500, np.int64), np.full((500, group.max() + 1), -1.0)
    for _ in range(8):
        at, dist, low, _ = vc.assigned(x, books, group, at, low)
        full = ((x[:, None] - books[None]) ** 2).sum(2)
        assert (at == full.argmin(1)).all() and (dist == full.min(1)).all()
        others = full.astype(float)
        others[np.arange(500), at] = np.inf
        for g in range(group.max() + 1):
            assert (vc.down(low)[:, g] <= np.sqrt(others[:, group == g].min(1))).all()
        moved = books + r.integers(-4, 5, books.shape)
        drift = np.zeros(group.max() + 1)
        np.maximum.at(drift, group, np.sqrt(((moved - books) ** 2).sum(1)))
        books, low = moved, vc.down(low).astype(float) - drift * (1 + 1e-9)
