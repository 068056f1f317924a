"""Sensor series: as-of joins, quality rules, repair, and forecasting features. The rules are this library's own."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import scanned, segmented


def asof_join(left: DataFrame, right: DataFrame, on: str, by: str, values: list[str], suffix: str = "_asof", segments: int | None = None) -> DataFrame:
    """left with the values of the last right row of the same `by` at or before `on`.

    Both sides are dealt into ranges of (by, on) and scanned range by range, so no task holds a key; no range join.
    """
    a = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias("_" + v) for v in values], F.lit(1).alias("_side"))
    b = right.select(on, by, *[F.col(v).alias("_" + v) for v in values], F.lit(0).alias("_side"))
    both = segmented(a.unionByName(b, allowMissingColumns=True), [by], [on, "_side"], "_segment", segments)
    seen = scanned(both, [by], [on, "_side"], "_segment", back={v + suffix: F.col("_" + v) for v in values})
    return seen.where("_side = 1").select(*left.columns, *[v + suffix for v in values])


#: How far from a percentile its approximate bounds are asked for, and the accuracy that keeps them on their sides.
MARGIN, ACCURACY = 0.001, 10_000


def exact_percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, one column a name): exact percentiles of a key's values with linear interpolation, nulls left out.

    No task holds a key's values: two approximate percentiles about each one bound it, what lies below is counted, and
    only the distinct values between the bounds are ranked.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    ends = [min(1.0, max(0.0, p + m)) for p in shares.values() for m in (-MARGIN, MARGIN)]
    known = rows.groupBy("_k").agg(F.count("*").alias("n"), F.percentile_approx("_v", ends, ACCURACY).alias("ends"))
    few = F.col("n") <= 2 / MARGIN  # then the next value may be further off than the margin: all are looked at
    end = lambda i, other: F.when(few, F.lit(other)).otherwise(F.get("ends", i))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), end(2 * i, float("-inf")).alias("lo"), end(2 * i + 1, float("inf")).alias("hi")) for i, (name, p) in enumerate(shares.items())])
    at = rows.join(known.withColumn("asked", asked).drop("ends"), "_k").select("_k", "_v", "n", F.explode("asked").alias("a"))
    place = F.when(F.col("_v") < F.col("a.lo"), float("-inf")).otherwise(F.col("_v"))  # all below the bound are one
    counts = at.where(F.col("_v") <= F.col("a.hi")).groupBy("_k", "n", "a.name", "a.p", place.alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_k", "name").orderBy("v"))
    rank = F.col("p") * (F.col("n") - 1)
    first = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    found = counts.withColumn("upto", upto).groupBy("_k", "name").agg(first(F.floor(rank)).alias("a"), first(F.ceil(rank)).alias("b"), F.first(rank - F.floor(rank)).alias("part"))
    between = found.select("_k", "name", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("v"))
    wide = between.groupBy("_k").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in shares])
    return wide.withColumnRenamed("_k", key)


def quality_flags(df: DataFrame, key: str, ts: str, value: str, low: float, high: float, jump: float, stuck: int, segments: int | None = None) -> DataFrame:
    """df with flag: missing, range, jump, stuck (equal for `stuck` readings in a row) or ok.

    Series are scanned in ranges of (key, ts); a run of equal readings that goes on over several ranges is one row.
    """
    rows = segmented(df, [key], [ts], "_segment", segments)
    seen = scanned(rows, [key], [ts], "_segment", before={"_last": F.struct(F.col(value).alias("v"))})
    fresh = F.when(F.col("_last").isNotNull() & F.col(value).eqNullSafe(F.col("_last.v")), 0).otherwise(F.when(F.col("_last").isNull() & F.col(value).isNull(), 0).otherwise(1))
    runs = scanned(seen, [key], [ts], "_segment", sums={"_run": fresh})
    runs = runs.withColumn("_size", F.count("*").over(Window.partitionBy("_segment", key, "_run")))
    long = runs.groupBy(F.col(key).alias("_key"), F.col("_run").alias("_of")).agg(F.count("*").alias("_all"), F.min("_segment").alias("_lo"), F.max("_segment").alias("_hi")).where("_lo < _hi").drop("_lo", "_hi")
    runs = runs.join(F.broadcast(long), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_of")), "left")  # a row a border of ranges at most
    flag = (
        F.when(F.col(value).isNull(), "missing").when((F.col(value) < low) | (F.col(value) > high), "range")
        .when(F.abs(F.col(value) - F.col("_last.v")) > jump, "jump").when((F.coalesce("_all", "_size") >= stuck) & (F.col(value) != 0), "stuck").otherwise("ok")
    )
    return runs.select(*df.columns, flag.alias("flag"))


def repair(df: DataFrame, key: str, ts: str, value: str, segments: int | None = None) -> DataFrame:
    """df with repaired: flagged readings by linear interpolation in time between good neighbours, else the nearest one.

    The good neighbours are looked for both ways, in ranges of (key, ts) and over their borders.
    """
    t = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    good = F.when(F.col("flag") == "ok", F.struct(F.col(value).alias("v"), t(F.col(ts)).alias("t")))
    seen = scanned(segmented(df, [key], [ts], "_segment", segments), [key], [ts], "_segment", back={"_b": good}, ahead={"_a": good})
    v0, v1, t0, t1 = (F.col(c) for c in ("_b.v", "_a.v", "_b.t", "_a.t"))
    between = F.when(t1 > t0, v0 + (v1 - v0) * (t(F.col(ts)) - t0) / (t1 - t0)).otherwise(v0)
    return seen.select(*df.columns, F.when(F.col("flag") == "ok", F.col(value)).otherwise(F.coalesce(between, v0, v1)).alias("repaired"))


def forecast_features(df: DataFrame, key: str, ts: str, value: str, lags: int, ahead: int) -> DataFrame:
    """df with lag_1..lags, mean, and target: the value `ahead` readings on."""
    w = Window.partitionBy(key).orderBy(ts)
    cols = [F.lag(value, i).over(w).alias(f"lag_{i}") for i in range(1, lags + 1)]
    return df.select("*", *cols, F.avg(value).over(w.rowsBetween(-lags, 0)).alias("mean"), F.lead(value, ahead).over(w).alias("target"))


def model_flags(df: DataFrame, key: str, ts: str, value: str, limit: float = 8.0, seed: int = 0) -> DataFrame:
    """df(…, flag) with flags "model" for readings that pass the rules but not a forest's guess from their neighbours.

    The forest learns from readings the rules let pass; one is flagged if it is further from the guess than `limit`
    times the median distance. The rules and the limit are this library's own.
    """
    w = Window.partitionBy(key).orderBy(ts)
    good = F.when(F.col("flag") == "ok", F.col(value))
    near = [(n, f(good, k).over(w)) for n, f, k in (("_b2", F.lag, 2), ("_b1", F.lag, 1), ("_a1", F.lead, 1), ("_a2", F.lead, 2))]
    rows = df.select("*", *[c.alias(n) for n, c in near]).withColumn("_ok", (F.col("flag") == "ok") & F.col("_b1").isNotNull() & F.col("_a1").isNotNull())
    rows = rows.withColumn("_b2", F.coalesce("_b2", "_b1")).withColumn("_a2", F.coalesce("_a2", "_a1")).withColumn("_y", F.col(value).cast("double"))
    inputs = VectorAssembler(inputCols=["_b2", "_b1", "_a1", "_a2"], outputCol="_x", handleInvalid="skip")
    model = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="_guess", numTrees=20, maxDepth=6, seed=seed).fit(inputs.transform(rows.where("_ok")))
    guessed = model.transform(inputs.transform(rows.where("_ok"))).withColumn("_off", F.abs(F.col("_y") - F.col("_guess")))
    middle = guessed.agg(F.percentile_approx("_off", 0.5, 1_000).alias("_middle"))
    flagged = guessed.join(F.broadcast(middle)).withColumn("flag", F.when(F.col("_off") > limit * F.col("_middle"), "model").otherwise(F.col("flag")))  # one row
    return flagged.select(*df.columns).unionByName(rows.where("NOT _ok").select(*df.columns))
