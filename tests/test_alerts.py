"""Alerts over several runs of a stream: state lives on in its checkpoint, and goes after silence."""

from datetime import datetime, timedelta

from aidlake.streaming import monitor

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def test_state_survives_a_restart_and_goes_after_silence(spark, tmp_path):
    events, out, check = (str(tmp_path / n) for n in ("events", "out", "check"))

    def add(*rows):
        made = [(i, u, None if h is None else START + timedelta(hours=h), v) for i, u, h, v in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(events)

    def restart():
        def batch(spark, _):
            stream = spark.readStream.schema(SCHEMA).parquet(events).withWatermark("ts", "1 hour")
            q = monitor.alerts(stream, 10.0, 5.0, 6 * 3_600_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            q.awaitTermination()
            return q.lastProgress["stateOperators"][0]["numRowsTotal"]

        held = monitor.durable(batch)(spark, "")
        return sorted(r.event_id for r in spark.read.schema("user_id long, event_id long, value double").parquet(out).collect()), held

    add((1, 7, 0, 3.0), (2, 7, 1, 11.0), (3, 7, 2, 12.0), (4, 8, 1, 20.0), (5, 8, 2, 4.0), (6, 8, 2.5, 30.0), (7, None, 1, 99.0), (8, 9, None, 99.0), (9, 9, 2, None))
    got, _ = restart()
    assert got == [2, 4, 6]
    add((10, 7, 3, 15.0), (11, 7, 2.9, 7.0), (12, 8, 3, 1.0), (13, 8, 3, 40.0))  # 7 is still open; 8 closes and opens at one time
    got, held = restart()
    assert got == [2, 4, 6, 13] and held > 0
    add((14, 5, 30, 1.0))  # time goes on: the silent ones' state goes
    got, left = restart()
    assert got == [2, 4, 6, 13] and 0 < left < held
    add((15, 7, 30, 15.0), (16, 7, 30.5, 16.0))  # after silence an alert opens anew
    got, _ = restart()
    assert got == [2, 4, 6, 13, 15]
    assert spark.conf.get(monitor.ROCKS[0]) != monitor.ROCKS[1]
