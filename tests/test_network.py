"""Networks trained over tasks: gradients against differences and one task's, what they learn, and rows that teach nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aidlake.operators import network


def drawn(classes, seed=1, sizes=(3, 5, 4, 2)):
    r = np.random.default_rng(seed)
    n = sum(a * b + b for a, b in zip(sizes, sizes[1:], strict=False))
    net = network.Network(sizes, classes, r.normal(size=n), r.normal(size=3), r.uniform(0.5, 2, 3), r.normal(size=2), r.uniform(0.5, 2, 2))
    return net, r.normal(size=(7, 3)), r.integers(0, 2, (7, 1)).astype(float) if classes else r.normal(size=(7, 2))


@pytest.mark.parametrize("classes", [True, False])
def test_gradients_against_differences(classes):
    net, x, y = drawn(classes)
    _, grad = net.gradient(x, y)
    flat, h = net.weights.copy(), 1e-6
    for n in range(len(flat)):
        ends = []
        for s in (h, -h):
            net.weights = flat.copy()
            net.weights[n] += s
            ends.append(net.gradient(x, y)[0])
        assert (ends[0] - ends[1]) / (2 * h) == pytest.approx(grad[n], rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("fan", [2, 64])
def test_sums_of_tasks_are_those_of_all_rows(spark, monkeypatch, fan):
    monkeypatch.setattr(network, "FAN", fan)
    net, _, _ = drawn(False)
    r = np.random.default_rng(4)
    rows = [tuple(map(float, v)) for v in r.normal(size=(101, 5))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, z double").repartition(13)
    loss, grad = network._sums(df, net, 3, 13)
    want = net.gradient(np.array(rows)[:, :3], np.array(rows)[:, 3:])
    assert loss == pytest.approx(want[0]) and np.allclose(grad, want[1])


def test_a_bend_that_no_line_follows(spark):
    r = np.random.default_rng(2)
    rows = [(float(a), float(b), int(a * b > 0), float(a * b)) for a, b in r.uniform(-1, 1, (800, 2))]
    bad = [(None, 0.5, 1, 1.0), (float("nan"), 0.5, 1, 1.0), (0.5, float("inf"), 0, 1.0), (0.5, 0.5, None, None)]
    df = spark.createDataFrame(rows + bad, "a double, `b.x` double, k int, p double").withColumn("part", F.lit("x"))
    trace = []
    net = network.fit(df, ["a", "b.x"], ["k"], [8], classes=2, rounds=60, trace=trace)
    out = df.withColumn("got", network.predict(net, ["a", "b.x"])).collect()
    assert all(x.got is None for x in out if x.a is None or np.isnan(x.a) or np.isinf(x["b.x"])) and out[-1].got is not None
    right = np.mean([x.got[0] == x.k for x in out if x.got is not None and x.k is not None])
    assert right > 0.93 and min(trace) < 0.3 * trace[0]
    again = network.fit(df, ["a", "b.x"], ["k"], [8], classes=2, rounds=3)
    assert np.array_equal(again.weights, network.fit(df, ["a", "b.x"], ["k"], [8], classes=2, rounds=3).weights)
    numbers = network.fit(df, ["a", "b.x"], ["p"], [8], rounds=60)
    got = [(x.got[0], x.p) for x in df.withColumn("got", network.predict(numbers, ["a", "b.x"])).collect() if x.got is not None and x.p is not None]
    assert np.mean([(a - b) ** 2 for a, b in got]) < 0.2 * np.var([b for _, b in got])


def test_no_rows_and_constant_columns(spark):
    none = spark.createDataFrame([], "a double, k int")
    net = network.fit(none, ["a"], ["k"], [3], classes=2)
    assert none.withColumn("got", network.predict(net, ["a"])).collect() == []
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, y double")
    net = network.fit(same, ["a"], ["y"], [3], rounds=20)
    assert same.select(network.predict(net, ["a"]).alias("got")).first().got[0] == pytest.approx(2.0, abs=0.1)


@pytest.mark.parametrize("classes", [True, False])
def test_equal_rows_are_reckoned_once_with_their_number(spark, monkeypatch, classes):
    monkeypatch.setattr(network, "PACK", 3, raising=False)
    net, x, y = drawn(classes)
    rows = [tuple(map(float, (*a, *b))) for a, b in zip(x, y, strict=True)]
    names = ["a", "b", "c", "y", "z"][: 3 + y.shape[1]]
    df = spark.createDataFrame([r for n, r in enumerate(rows) for _ in range(n + 1)], ", ".join(f"{n} double" for n in names)).repartition(5)
    packed = network._packed(df)
    assert sum(len(r.packed) for r in packed.collect()) == 8 * len(rows) * (len(names) + 1)
    loss, grad = network._sums(packed, net, 3, 5)
    want = net.gradient(np.repeat(x, range(1, 8), axis=0), np.repeat(y, range(1, 8), axis=0))
    assert loss == pytest.approx(want[0]) and np.allclose(grad, want[1])
