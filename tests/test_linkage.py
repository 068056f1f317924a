"""Record linkage against all pairs of a small table, with hot keys, nulls, ties and an empty table."""

import os

import pytest
from pyspark.sql import functions as F

from aidlake.operators import linkage
from aidlake.plans import extended


def test_neighbours_are_those_of_sorted_lists(spark):
    rows = [(i, ["hot", "b", "c", None, ""][i % 5] if i % 2 else "hot", f"f{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, key string, f string")
    got = sorted(map(tuple, linkage.neighbours(df, "id", [F.col("key"), F.reverse("key")], ["f"], 4).collect()))
    want = set()
    for turn in (lambda k: k, lambda k: k[::-1]):
        s = [i for _, _, i in sorted((turn(k), f, i) for i, k, f in rows if k)]
        want |= {(min(x, y), max(x, y)) for n, x in enumerate(s) for y in s[n + 1 : n + 4]}
    assert got == sorted(want)


def test_scores_and_fields_that_are_missing(spark):
    rows = [(1, "a", "anna berg", "12345"), (2, "b", "ana berg", "12345"), (3, "b", "anna berg", None), (4, "a", "anna berg", "12345"), (5, "b", None, "12345"), (6, "b", None, None), (None, "b", "anna berg", "12345"), (7, "b", "zoe", "99")]
    df = spark.createDataFrame(rows, "id long, source string, name string, phone string").withColumn("score", F.lit(1)).withColumn("n", F.lit(1))
    run = lambda **k: {(r.a, r.b): r.score for r in linkage.linked(df, "id", {"name": 0.5, "phone": 0.5}, [F.col("name"), F.col("phone")], 0.8, **k).collect()}
    apart = run(across="source")
    assert set(apart) == {(1, 2), (1, 3), (1, 5), (2, 4), (3, 4), (4, 5)}
    assert apart[1, 2] == pytest.approx((8 / 9 + 1) / 2) and apart[1, 3] == apart[1, 5] == 1
    assert (1, 4) in run() and linkage.linked(df.limit(0), "id", {"name": 1.0}, [F.col("name")]).collect() == []


def test_planted_parties(spark):
    r = extended.linked_parties(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).first()
    assert r.right >= 0.9 * r.planted > 0 and r.right >= 0.95 * r.found
