"""SQLite tables: filters that reach it, tables without rowid, views, and writing that shows all or nothing."""

import math
import os
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, IsNull, LessThanOrEqual, Not, StringStartsWith

from aidlake.sources import files


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "a b.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE calls (id INTEGER, "pla""ce" TEXT COLLATE NOCASE, depth REAL, day DATE)')
        c.executemany("INSERT INTO calls VALUES (?, ?, ?, ?)", [(i, None if i == 4 else "Ab" if i % 2 else "aB", None if i == 3 else i / 2, "2024") for i in range(25)])
        c.execute("CREATE TABLE keyed (k TEXT, v INTEGER, PRIMARY KEY (k, v)) WITHOUT ROWID")
        c.executemany("INSERT INTO keyed VALUES (?, ?)", [("hot", i) for i in range(40)] + [(f"k{i}", i) for i in range(9)])
        c.execute("CREATE TABLE bare (k INTEGER PRIMARY KEY, v TEXT) WITHOUT ROWID")
        c.execute("CREATE VIEW deep AS SELECT id, depth FROM calls WHERE depth > 5")
    return path


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_conditions_that_sqlite_judges_as_spark_does(db):
    r = files.PushingReader({"path": db, "table": "calls"}, ["id"])
    p = 'pla"ce'
    kept = [StringStartsWith((p,), "A"), EqualTo(("id",), 1.5), GreaterThan(("day",), "2023"), EqualTo(("depth",), math.nan), EqualTo(("id",), True), In(("id",), (1, None)), EqualTo(("a", "b"), 1)]
    sent = [GreaterThan(("id",), 3), EqualTo((p,), "Ab"), Not(EqualNullSafe(("id",), 7)), In(("depth",), (2.5, 3.0)), IsNull(("day",)), LessThanOrEqual(("id",), 9)]
    assert list(r.pushFilters(kept + sent)) == kept
    sql, values = r.statement(files.Rows(0, 10))
    assert sql == ('SELECT "id" FROM "calls" WHERE "id" > ? AND "pla""ce" COLLATE BINARY = ? AND NOT ("id" IS ?) AND "depth" IN (?, ?) AND "day" IS NULL AND "id" <= ? AND rowid >= ? AND rowid < ?')
    assert values == [3, "Ab", 7, 2.5, 3.0, 9, 0, 10]


@pytest.mark.parametrize("where", ["id > 3 and `pla\"ce` = 'Ab'", "`pla\"ce` <> 'Ab'", "depth in (2.5, 3.0) or id = 4", "not (depth > 2)", "depth is null", "id <=> 5", "not (id <=> 5)", "`pla\"ce` is not null and day = '2024'", "id in (1, 2, 99)", "`pla\"ce` like 'a%'"])
def test_pushed_filters_give_the_same_rows(pushing, db, where):
    got = sorted(r.id for r in files.sqlite(pushing, db, "calls").where(where).collect())
    pushing.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    want = sorted(r.id for r in files.sqlite(pushing, db, "calls").where(where).collect())
    assert got == want and (got or where == "id in (99)")


def test_tables_without_rowid_and_views(spark, db):
    keyed = files.sqlite(spark, db, "keyed")
    assert sorted(map(tuple, keyed.collect())) == sorted([("hot", i) for i in range(40)] + [(f"k{i}", i) for i in range(9)])
    reader = files.SqliteReader({"path": db, "table": "keyed", "partitions": "6"}, ["k", "v"])
    parts = reader.partitions()
    assert len(parts) > 1 and sorted(x for p in parts for x in reader.read(p)) == sorted(map(tuple, keyed.collect()))
    assert files.sqlite(spark, db, "bare").collect() == []
    assert sorted(r.id for r in files.sqlite(spark, db, "deep").collect()) == [i for i in range(25) if i / 2 > 5]


def test_written_tables(spark, tmp_path):
    path = str(tmp_path / "out.db")
    df = spark.range(100).select(F.col("id").alias('i"d'), F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), "id")).alias("select"), (F.col("id") / 4).alias("x"), (F.col("id") % 2 == 0).alias("even"), F.encode(F.col("id").cast("string"), "UTF-8").alias("b")).repartition(6)
    spark.dataSource.register(files.SqliteSource)
    out = lambda d, mode: d.write.format("sqlite").option("path", path).option("table", "t").mode(mode).save()
    out(df, "append")
    back = lambda: sorted((tuple(r) for r in files.sqlite(spark, path, "t").collect()), key=lambda r: r[0])
    want = sorted(((r[0], r[1], r[2], int(r[3]), r[4]) for r in df.collect()), key=lambda r: r[0])
    assert back() == want
    out(df, "append")
    assert len(back()) == 200
    out(df.limit(0), "overwrite")
    assert back() == []
    out(df.where("x < 5"), "overwrite")
    bad = df.withColumn("x", F.when(F.col("x") > 20, F.raise_error(F.lit("planted"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="planted"):
        out(bad, "overwrite")
    assert back() == want[:20] and os.listdir(tmp_path) == ["out.db"]  # as it was; nothing is left of the parts
    nan = spark.createDataFrame([(1, float("nan"))], "a int, x double")
    nan.write.format("sqlite").option("path", path).option("table", "n").mode("append").save()
    assert tuple(files.sqlite(spark, path, "n").first()) == (1, None)
    with pytest.raises(Exception, match="cast its timestamp"):
        nan.select(F.current_timestamp().alias("ts")).write.format("sqlite").option("path", path).option("table", "n").mode("append").save()
