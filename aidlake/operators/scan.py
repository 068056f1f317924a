"""Scans in the order of a key's rows that hold no key in one task: ranges of rows, and what each range hands to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import table


def segmented(df: DataFrame, keys: list[str], order: list[str], segment: str = "segment", segments: int | None = None) -> DataFrame:
    """df dealt into ranges of (keys, order) and written; the new column `segment` numbers the ranges in that order.

    Nulls come first. Rows that tie in keys and order share a segment. A key with many rows has several segments, a
    segment many small keys.
    """
    n = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table(df.repartitionByRange(n, *keys, *order).withColumn(segment, F.spark_partition_id()), "segments")


def scanned(
    rows: DataFrame, keys: list[str], order: list[str], segment: str = "segment", *, back: dict[str, Column] | None = None, before: dict[str, Column] | None = None,
    ahead: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
) -> DataFrame:
    """The rows of segmented() with a column for each name, in the order of their key's rows.

    back: the last value that is not null up to the row; before: up to the row before it; ahead: the first that is not null
    from the row on; sums: the total up to the row, without nulls. Within a segment these are windows. What earlier or
    later segments of a key hand on is one aggregated row a segment; it matters to the first and the last key of a segment
    alone, so what is joined has two rows a segment at most and is broadcast.
    """
    back, before, ahead, sums = back or {}, before or {}, ahead or {}, sums or {}
    w = Window.partitionBy(segment, *keys).orderBy(*order)
    upto, past, rest = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    inside = rows.select(
        "*", *[F.last(c, True).over(upto).alias(n) for n, c in back.items()], *[F.last(c, True).over(past).alias(n) for n, c in before.items()],
        *[F.first(c, True).over(rest).alias(n) for n, c in ahead.items()], *[F.sum(c).over(upto).alias(n) for n, c in sums.items()],
    )
    at = lambda c: F.when(c.isNotNull(), F.struct(*order))
    last = [F.max_by(c, at(c)).alias(n) for n, c in (back | before).items()]
    states = rows.groupBy(segment, *keys).agg(*last, *[F.min_by(c, at(c)).alias(n) for n, c in ahead.items()], *[F.sum(c).alias(n) for n, c in sums.items()])
    over = Window.partitionBy(*keys).orderBy(segment)
    earlier, later = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    names = [*back, *before, *ahead, *sums]
    handed = [F.last(n, True).over(earlier) for n in (*back, *before)] + [F.first(n, True).over(later) for n in ahead] + [F.sum(n).over(earlier) for n in sums]
    same = [segment, *keys]
    carry = states.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(same)], *[c.alias(f"_carry{i}") for i, c in enumerate(handed)])
    some = F.lit(False)
    for i in range(len(names)):
        some |= F.col(f"_carry{i}").isNotNull()
    on = F.lit(True)
    for i, c in enumerate(same):
        on &= F.col(c).eqNullSafe(F.col(f"_of{i}"))
    out = inside.join(F.broadcast(carry.where(some)), on, "left")
    filled = {n: F.coalesce(n, f"_carry{i}") if n not in sums else F.coalesce(F.col(n) + F.col(f"_carry{i}"), n, f"_carry{i}") for i, n in enumerate(names)}
    return out.select(*rows.columns, *[c.alias(n) for n, c in filled.items()])


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n", segment: str = "segment") -> DataFrame:
    """The rows of segmented() with their number, from 1, among their key's."""
    return scanned(rows, keys, order, segment, sums={name: F.lit(1).cast("long")})
