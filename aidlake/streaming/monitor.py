"""Structured Streaming over an events folder: windows, sessions, duplicates, alerts, stateful levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources import shared

LATE = "1 hour"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events table, a file or a folder of files; ts becomes a timestamp with zone, which event time needs."""
    path = f"{sf_dir}/events.parquet"
    schema, where = spark.read.parquet(path).schema, spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        raw = reader.parquet(path)
    else:
        raw = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def finished(df: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is; its rows, from Parquet in the shared folder, where its checkpoint is too.

    Each micro-batch writes a folder of its own, again if it is repeated. The result is all of them in append mode,
    the last one in complete mode, and the last row of each key in update mode; no row passes through the driver.
    """
    spark = df.sparkSession
    base, schema = shared.folder(spark, "stream"), df.schema
    last: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        last[:] = [batch]
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{base}/rows/batch={last[0]}")
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(f"{base}/rows")
    if mode == "update" and key:
        newest = F.max_by(F.struct(*schema.names), "batch").alias("row")
        return rows.groupBy(*key).agg(newest).select(*[F.col("row").getField(c).alias(c) for c in schema.names])
    return rows.select(*schema.names)


def tumbling(stream: DataFrame, width: str = "1 day") -> DataFrame:
    w = stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str = "2 days", slide: str = "1 day") -> DataFrame:
    w = stream.groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def distinct(stream: DataFrame) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")


def followed(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Errors within a time after a purchase of the same user: a stream-stream interval join."""
    p = stream.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("u"), F.col("ts").alias("pt"))
    e = stream.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("et"))
    return p.join(e, F.expr(f"u = user_id AND et > pt AND et <= pt + INTERVAL {within}")).select("purchase_id", "error_id")


def levels(stream: DataFrame, alert: float = 400.0) -> DataFrame:
    """(user_id, seen, top, alerts): a running maximum and the number of values over a level, kept in state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, top, alerts = state.get if state.exists else (0, float("-inf"), 0)
        for pdf in batches:
            seen, top, alerts = seen + len(pdf), max(top, float(pdf.value.max())), alerts + int((pdf.value > alert).sum())
        state.update((seen, top, alerts))
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "top": [top], "alerts": [alerts]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, seen long, top double, alerts long", "seen long, top double, alerts long", "update", GroupStateTimeout.NoTimeout)


class Hysteresis(StatefulProcessor):
    """Alerts of one key: one opens with a value over `high` and closes with one under `low`, or after `quiet` of silence.

    State is whether an alert is open and the time of the last row; it goes by a timer once the watermark has passed `quiet`
    after that row, so silent keys hold none. Rows of a batch are taken by time, then by id. A row that is older than
    the last one of its key in an earlier batch comes too late to open or close anything. A null value changes nothing.
    """

    def __init__(self, high: float, low: float, quiet: int):
        self.high, self.low, self.quiet = high, low, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", "open boolean, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else None
        is_open, last = before or (False, None)
        opened = []
        for r in pd.concat(rows).sort_values(["ms", "event_id"]).itertuples():
            if before and r.ms < before[1]:
                continue
            if last is not None and r.ms - last > self.quiet:
                is_open = False
            last = r.ms
            if r.value > self.high and not is_open:
                is_open = True
                opened.append((key[0], r.event_id, r.value))
            elif r.value < self.low:
                is_open = False
        if last is not None and (before is None or last != before[1]):
            if before:
                self.handle.deleteTimer(before[1] + self.quiet + 1)
            self.handle.registerTimer(last + self.quiet + 1)
        if last is not None:
            self.state.update((is_open, last))
        yield pd.DataFrame(opened, columns=["user_id", "event_id", "value"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame(columns=["user_id", "event_id", "value"])

    def close(self) -> None:
        pass


def alerts(stream: DataFrame, high: float = 250.0, low: float = 50.0, quiet: int = 24 * 3_600_000) -> DataFrame:
    """(user_id, event_id, value): the rows with which an alert of their user opens; quiet is in milliseconds.

    Needs a state store of RocksDB, which durable() sets. Rows without a user or time are no one's; those behind the
    watermark are left to it.
    """
    rows = stream.where("user_id is not null and ts is not null").withColumn("ms", F.unix_millis("ts")).select("user_id", "event_id", "value", "ts", "ms")
    return rows.groupBy("user_id").transformWithStateInPandas(Hysteresis(high, low, quiet), "user_id long, event_id long, value double", "append", "eventTime")


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def durable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query with state in RocksDB, beyond what the heap holds; the session's own choice is put back."""

    def with_rocks(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = spark.conf.get(ROCKS[0], None)
        spark.conf.set(*ROCKS)
        try:
            return query(spark, sf_dir)
        finally:
            spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])

    return with_rocks


def run(step: Callable[[DataFrame], DataFrame], mode: str, key: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: finished(step(events(spark, sf_dir)), mode, key)
