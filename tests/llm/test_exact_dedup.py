import hashlib
import random

import pytest
from pyspark.sql import functions as F

from aidlake.llm import exact_dedup

SCHEMA = "doc_id long, text string, `digest` string, `a.salt` int, keep_id string"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made():
    r = random.Random(5)
    texts = ["", None, "a", "A", "Ä", "ä", "a ", "long " * 4_000, "LONG " * 4_000, "İx", "i̇x", "a\x00b", "A\x00B"]
    rows = [(i, r.choice(texts), "d", i, None) for i in range(300)]
    rows += [(1000 + i, "hot", None, 1, "k") for i in range(700)]
    return rows + [(5, "tie", "x", 1, "y"), (5, "tie", "x", 1, "y"), (5, "TIE", "z", 2, "y"), (None, "n", None, None, None), (None, "N", None, None, None), (None, "hot", None, None, None)]


def test_against_brute_force(spark):
    rows = made()
    assert got(exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


@pytest.mark.parametrize("digest", [lambda t: F.lit("x"), lambda t: F.length(t) % 3])
def test_texts_that_share_a_digest_are_told_apart_by_content(spark, digest):
    rows = made()
    assert got(exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA), digest=digest)) == brute(rows)


def test_empty(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_kept_rows_with_all_their_columns(spark):
    rows = made()
    left = exact_dedup.without_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {(keep, sha) for _, keep, _, _, sha in brute(rows)}
    assert sorted(((r.doc_id, hashlib.sha256(lowered(r.text).encode()).hexdigest()) for r in left), key=str) == sorted(want, key=str)
    assert left[0].asDict().keys() == {"doc_id", "text", "digest", "a.salt", "keep_id"}


def test_native_plan_that_combines_before_each_exchange(spark):
    plan = exact_dedup.combined(spark.createDataFrame(made(), SCHEMA).selectExpr("doc_id as id", "text as digest", "1 as salt", "text as norm"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 4 and plan.count("Exchange hashpartitioning") == 2 and "partial_max" in plan
    whole = exact_dedup.exact_groups(spark.createDataFrame(made(), SCHEMA))._jdf.queryExecution().toString()
    assert not any(w in whole for w in ("Python", "Pandas", "Arrow"))


def test_a_hot_group_meets_its_rows_in_many_tasks(spark):
    rows = spark.range(5_000).selectExpr("id as doc_id", "'same' as text")
    norm = rows.select(F.col("doc_id").alias("id"), F.lit("d").alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(exact_dedup.SALTS)).cast("int").alias("salt"), F.lit("same").alias("norm"))
    slots = exact_dedup.by_salt(exact_dedup.combined(norm)).collect()
    assert sorted(s.salt for s in slots) == list(range(exact_dedup.SALTS)) and {s.n for s in slots} == {5_000}
