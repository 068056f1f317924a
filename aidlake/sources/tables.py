"""Tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lazy scan: filters and column choices of the query reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL whose {names} are tables of the folder; no view is registered, so sessions stay clean."""
    used = {n: table(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in text}
    return spark.sql(text, **used)
