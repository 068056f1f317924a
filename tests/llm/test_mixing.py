import random
from collections import defaultdict

import pytest

from aidlake.llm import mixing

SCHEMA = "doc_id long, source string, size long, target int, sk string"


def water(sizes, weights, most):
    """Targets by sharing again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        above = [s for s in free if level * w[s] > most * sizes[s]]
        if not above:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: most * sizes[s] for s in above}


def rows_of(seed, n=3_000):
    r = random.Random(seed)
    names = ["hot"] * 20 + ["a", "B", "é", "z", "ü", "\U0001f600", "￿", None, "tiny"]
    out = [(i, s, int(r.paretovariate(1.2) * 20) if r.random() > 0.05 else r.choice([0, None]), 1, "s") for i in range(n) for s in [r.choice(names)] if s != "tiny" or r.random() < 0.05]
    return out


@pytest.mark.parametrize("block,fan", [(4096, 64), (16, 3)])
def test_targets_and_rounding(spark, monkeypatch, block, fan):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    rows = rows_of(3)
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(o.doc_id for o in out) == sorted(r[0] for r in rows)
    sizes = defaultdict(int)
    for _, s, n, *_ in rows:
        sizes[s] += n or 0
    want = water(sizes, (1, 2, 3), 3)
    taken = defaultdict(int)
    for o in out:
        assert o.source_size == sizes[o.source] and abs(o.target - want[o.source]) < 1e-6 * (1 + want[o.source])
        ratio = o.target / o.source_size if o.source_size else 0
        assert o.taken == o.copies * (o.size or 0) and int(ratio + 1e-9) <= o.copies + 1e-9 and o.copies <= min(3, ratio + 1)
        taken[o.source] += o.taken
    for s, t in want.items():
        largest = max(n or 0 for _, x, n, *_ in rows if x == s)
        assert abs(taken[s] - t) <= max(1, largest)
    assert abs(sum(taken.values()) - sum(want.values())) < 0.02 * sum(want.values())


def test_reruns_agree_whatever_the_partitions(spark):
    rows = rows_of(4, 800)
    one = {o.doc_id: o.copies for o in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    two = {o.doc_id: o.copies for o in mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()}
    assert one == two


def test_draws_are_fair(spark):
    rows = [(i, "a", 10 + i % 7, 0, "") for i in range(40)] + [(100 + i, "b", 10, 0, "") for i in range(10)]
    df, n, sums = spark.createDataFrame(rows, SCHEMA), 60, defaultdict(int)
    for seed in range(n):
        for o in mixing.mix(df, seed=seed).collect():
            sums[o.doc_id] += o.copies
            ratio = o.target / o.source_size
            assert o.copies in (int(ratio), int(ratio) + 1)
    first = [sums[i] / n for i in range(40)]
    want = water({"a": sum(r[2] for r in rows[:40]), "b": 100}, (1, 2, 3), 3)["a"] / sum(r[2] for r in rows[:40])
    assert abs(sum(first) / 40 - want) < 0.03 and all(abs(f - want) < 0.35 for f in first)


def test_repeats_and_empty(spark):
    rows = [(1, "a", 5, 0, "")] * 50 + [(None, None, None, None, None)] * 3
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 53 and all(o.taken == 0 for o in out if o.source is None)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sizes_count_words(spark):
    rows = [(1, "a b\x1cc\t\n d"), (2, None), (3, ""), (4, "\x0b\x0c"), (5, "x y")]
    got = {r.doc_id: r["size"] for r in mixing.with_size(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 3, 2: 0, 3: 0, 4: 0, 5: 1}
