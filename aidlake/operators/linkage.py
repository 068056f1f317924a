"""Records of one party in sources that share no key: sorted neighbourhoods and a score of their fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import table
from .scan import numbered, segmented


def likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; null where one is null or both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNotNull() & b.isNotNull() & (longest > 0), 1 - F.levenshtein(a, b) / longest)


def neighbours(records: DataFrame, id_col: str, keys: list[Column], fields: list[str], window: int) -> DataFrame:
    """(a, b), a < b, each pair once: records that stand within `window` places of each other in the order of a key.

    An order is sorted and numbered over ranges of rows; the pairs of a pass are an equi-join on places, window - 1 a
    record at most, however many records share a key. Records of one key stand by their fields, so that full copies are
    neighbours. A record whose key is null or empty takes no part in that pass.
    """
    passes = []
    for key in keys:
        rows = records.select(key.alias("_key"), F.col(id_col).alias("_id"), *[F.col(f).alias(f"_f{n}") for n, f in enumerate(fields)]).where("_key <> ''")
        order = ["_key", *[f"_f{n}" for n in range(len(fields))], "_id"]
        placed = table(numbered(segmented(rows, [], order), [], order, "n").select("n", "_id"), "places")
        ahead = placed.select(F.col("_id").alias("x"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + window - 1)).alias("n"))
        passes.append(ahead.join(placed, "n").select(F.least("x", "_id").alias("a"), F.greatest("x", "_id").alias("b")))
    return reduce(DataFrame.unionByName, passes).where("a <> b").distinct()


def linked(records: DataFrame, id_col: str, weights: dict[str, float], keys: list[Column], least: float = 0.8, window: int = 8, across: str | None = None) -> DataFrame:
    """(a, b, score): pairs of neighbours whose fields are alike: the weighted mean of their likenesses, `least` or more.

    weights has the fields and what each counts; a field that one of the two lacks counts for nothing, and a pair without any
    common field is none. across, if given, is a column whose values must differ, as between sources. Ids must be unique;
    records without one are left out. As in any sorted neighbourhood, a pair that stands further apart in every pass is missed.
    """
    fields = list(weights)
    r = records.where(F.col(id_col).isNotNull())
    side = lambda s: r.select(F.col(id_col).alias(s), *[F.col(c).alias(f"{s}_{n}") for n, c in enumerate([*fields, *([across] if across else [])])])
    pairs = neighbours(r, id_col, keys, fields, window).join(side("a"), "a").join(side("b"), "b")
    if across:
        pairs = pairs.where(F.col(f"a_{len(fields)}") != F.col(f"b_{len(fields)}"))
    like = [likeness(F.col(f"a_{n}"), F.col(f"b_{n}")) for n in range(len(fields))]
    total = sum((F.coalesce(c * weights[f], F.lit(0.0)) for f, c in zip(fields, like, strict=True)), F.lit(0.0))
    common = sum((F.when(c.isNotNull(), weights[f]).otherwise(0.0) for f, c in zip(fields, like, strict=True)), F.lit(0.0))
    return pairs.withColumn("score", F.when(common > 0, total / common)).where(F.col("score") >= least).select("a", "b", "score")
