"""Exact duplicates by skew-safe combining, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_name, written

#: Shares of a group's rows; a bit of a long stands for each.
SALTS = 32


def normalised(text: Column) -> Column:
    """The text with A-Z, and no other letter, in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def combined(rows: DataFrame) -> DataFrame:
    """(digest, norm, keep, n, salts) of each distinct text of rows(id, digest, salt, norm).

    Each task first combines the equal texts it has read (Spark's partial aggregation), then those of a digest and salt
    meet, then the winners of the salts. The text is part of the key in every step, so texts are equal by content, not
    by digest. A group of any size sends a row a task and salt to the first exchange and SALTS rows to the second.
    """
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"), F.bit_or(bit(F.col("salt"))).alias("salts"))


def by_salt(groups: DataFrame) -> DataFrame:
    """A row of groups for each salt that its rows have, so that a large group's rows find it in as many tasks."""
    has = lambda i: F.col("salts").bitwiseAND(bit(i)) != 0
    return groups.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), has))).drop("salts")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row: the texts that are equal but for the case of A-Z.

    The row with the largest id of a group stays; keep_id is its id. Null texts count as empty ones and so are copies of
    each other. A null id never beats another; a group without any other id has keep_id null, and its rows are kept.
    Rows that repeat both id and text are one row written twice: all of them count in group_size and are marked alike.
    An empty table gives none. Texts of any length are compared whole; other columns are ignored, whatever their names.

    Groups come back to the rows by digest and salt. Where different texts share a digest (none known for SHA-256), the
    rows of that digest come back by their whole text instead.
    """
    norm = normalised(by_name(text_col).cast("string"))
    rows = df.select(by_name(id_col).alias("id"), digest(norm).alias("digest"), F.pmod(F.xxhash64(by_name(id_col)), F.lit(SALTS)).cast("int").alias("salt"), norm.alias("norm"))
    known = written(combined(rows).drop("norm"), "exact-groups")
    shared = written(known.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "shared-digests")
    if shared.isEmpty():
        found = rows.join(by_salt(known), ["digest", "salt"])
    else:
        alone = rows.join(by_salt(known.join(shared, "digest", "left_anti")), ["digest", "salt"])
        doubtful = rows.join(shared, "digest", "left_semi")
        found = alone.unionByName(doubtful.join(by_salt(combined(doubtful)), ["digest", "salt", "norm"]))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    return found.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), sha.alias("text_sha256"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_groups() does not keep; of rows that repeat id and text one stays."""
    keys = {"id": by_name(id_col), "sha": sha256(normalised(by_name(text_col).cast("string")))}
    stay = exact_groups(df, id_col, text_col).where("kept").select(by_name(id_col).alias("id"), F.col("text_sha256").alias("sha")).distinct()
    rows = df.select(F.struct(*[by_name(c).alias(c) for c in df.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])
    one = rows.join(stay, rows["id"].eqNullSafe(stay["id"]) & (rows["sha"] == stay["sha"]), "left_semi").dropDuplicates(["id", "sha"])
    return one.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
