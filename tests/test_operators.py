"""Operators that SQL cannot reach, against plain Python, and with nulls, ties and other fixtures."""

import heapq
import itertools
import json
import math
import os
import random
import sqlite3
import struct
import tracemalloc
import zlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aidlake.functions import geo
from aidlake.plans import catalog, extended
from aidlake.operators import allocation, gazetteer, graphs, inference, learning, pictures, rasters, recurrent, series, spatial, tagging, texts
from aidlake.sources import files
from aidlake.streaming import monitor


def test_shortest_paths_against_a_heap(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80), float(r.randrange(1, 30)), r.choice([0.0, 0.2, 0.5, 1.0])) for _ in range(300)] + [(900, 901, 1.0, 0.0)]
    best, todo = {}, [(0.0, 0)]
    while todo:
        c, n = heapq.heappop(todo)
        if n in best:
            continue
        best[n] = c
        for a, b, l, k in edges:
            if a == n and k < 1.0:
                heapq.heappush(todo, (c + l * (1 + 2 * k), b))
    df = spark.createDataFrame(edges, "src long, dst long, length double, risk double")
    edges += [(n, n, 0.0, 0.0) for n in range(5)] + [(3, 4, None, 0.0), (4, 5, 1.0, None)]
    for delta in (25.0, 1e9):  # several buckets, and one
        trace = []
        got = graphs.shortest_paths(df, spark.createDataFrame([(0,)], "node long"), risk_weight=2.0, delta=delta, trace=trace).collect()
        assert {g.node: round(g.cost, 6) for g in got} == {n: round(c, 6) for n, c in best.items()}
        assert (len({limit for limit, _, _ in trace}) > 1) == (delta < 1e6)
        moved, most = sum(m for _, _, m in trace), max(n for _, n, _ in trace)
        assert len(best) <= moved + 1 and (delta > 1e6 or most < len(best))  # narrow buckets leave settled nodes aside
    cost = {g.node: g.cost for g in got}
    assert all(g.previous is None or cost[g.previous] < g.cost for g in got)


def test_routes_cross_blocks_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK", 100)  # a ring of 400 nodes in eight blocks, and a hub whose edges lie in several
    edges = [(f"n{i:03}", f"n{(i + s) % 400:03}", float(s + i % 3), 0.0) for i in range(400) for s in (1, 3)] + [("n007", f"z{i:03}", 5.0, 0.0) for i in range(250)]
    edges += [(f"z{i:03}", "n200", 3.0, 0.0) for i in range(0, 250, 9)]
    best, todo, out = {}, [(0.0, "n000")], {}
    for a, b, w, _ in edges:
        out.setdefault(a, []).append((b, w))
    while todo:
        c, n = heapq.heappop(todo)
        if n not in best:
            best[n] = c
            for b, w in out.get(n, ()):
                heapq.heappush(todo, (c + w, b))
    trace = []
    got = graphs.shortest_paths(spark.createDataFrame(edges, "src string, dst string, length double, risk double"), spark.createDataFrame([("n000",)], "node string"), trace=trace).collect()
    assert {g.node: g.cost for g in got} == best and len(trace) <= 20, len(trace)  # routes have up to 130 edges
    assert all(g.previous is None or any(b == g.node and best[g.previous] + w == g.cost for b, w in out[g.previous]) for g in got)


def test_communities_of_two_cliques(spark):
    edges = [(a, b) for g in (range(5), range(10, 15)) for a in g for b in g if a < b] + [(4, 10)]
    got = {r.node: r.label for r in graphs.communities(spark.createDataFrame(edges, "src long, dst long"), 6).collect()}
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(11, 15)}) == 1


def test_haversine_and_bands(spark):
    df = spark.createDataFrame([(48.8566, 2.3522, 51.5074, -0.1278), (0.0, 0.0, 0.0, 180.0), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    km = [r[0] for r in df.select(geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert km[0] == pytest.approx(343.6, abs=0.5) and km[1] == pytest.approx(20015.1, abs=0.1) and km[2] == 0
    row = df.select(geo.warning(F.lit("Ann"), F.lit(12.0), geo.intensity_band(F.lit(12.0), F.lit(8.0)), F.lit(3.4)).alias("m")).first()
    assert row.m == "Ann: severe shaking, 12 km away, 3 s left, take cover now"


def test_ahp_by_hand(spark):
    pairs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 1 / 3), (1, 1, 1.0)], "i int, j int, v double")
    assert {r.i: round(r.weight, 9) for r in rasters.ahp(pairs).collect()} == {0: 0.75, 1: 0.25}


def test_focal_mean(spark):
    cells = spark.createDataFrame([(r, c, float(r * 3 + c)) for r in range(3) for c in range(3)], "row int, col int, value double")
    got = {(r.row, r.col): r.value for r in rasters.focal_mean(cells).collect()}
    assert got[1, 1] == 4.0 and got[0, 0] == 2.0 and len(got) == 9


def test_quality_and_repair(spark):
    t = datetime(2024, 1, 1)
    values = [1.0, 1.1, None, 99.0, 1.4, 2.0, 2.0, 2.0, 2.0, 1.0]
    df = spark.createDataFrame([("g", t + timedelta(hours=i), v) for i, v in enumerate(values)], "k string, ts timestamp_ntz, v double")
    flagged = series.quality_flags(df, "k", "ts", "v", 0.0, 50.0, 40.0, 4)
    got = {r.ts.hour: (r.flag, r.repaired) for r in series.repair(flagged, "k", "ts", "v").collect()}
    assert [got[i][0] for i in range(10)] == ["ok", "ok", "missing", "range", "jump", "stuck", "stuck", "stuck", "stuck", "ok"]
    assert got[2][1] == pytest.approx(1.1 + (1.0 - 1.1) / 8) and got[9][1] == 1.0


def test_asof_join_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 20, "a"), (3, 5, "a"), (4, 10, "b")], "id long, ts long, k string")
    right = spark.createDataFrame([("a", 10, 1), ("a", 15, 2), ("c", 1, 3)], "k string, ts long, v int")
    assert {r.id: r.v_asof for r in series.asof_join(left, right, "ts", "k", ["v"]).collect()} == {1: 1, 2: 2, 3: None, 4: None}


def test_exact_percentiles(spark):
    import numpy as np

    r, rows = random.Random(7), [("few", 3.0), ("none", None), ("two", 1.0), ("two", 2.0)] + [("tied", 5.0)] * 3_000 + [("tied", 6.0)]
    rows += [("many", r.gauss(0, 1)) for _ in range(6_000)] + [("hot", float(r.randrange(10))) for _ in range(4_000)] + [("hot", None)]
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "top": 1.0}
    got = {x.k: x for x in series.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares).collect()}
    assert set(got) == {"few", "two", "tied", "many", "hot"}
    for k, x in got.items():
        v = [b for a, b in rows if a == k and b is not None]
        assert all(x[n] == pytest.approx(float(np.quantile(v, p)), abs=1e-12) for n, p in shares.items()), k


def test_help_requests(spark):
    posts = spark.createDataFrame([(1, "Trapped near Green Hill School, 12 people, need water and food! call 138-0000-1111"), (2, "green hills far away"), (3, None)], "post_id long, text string")
    places = spark.createDataFrame([("Green Hill", 1.0, 2.0), ("Green Hill School", 3.0, 4.0), ("Far Away", 5.0, 6.0)], "place string, lat double, lon double")
    got = {r.post_id: r for r in texts.help_requests(posts, places).collect()}
    assert (got[1].place, got[1].people, sorted(got[1].needs), got[1].phones) == ("Green Hill School", [12], ["food", "water"], ["138-0000-1111"])
    assert got[2].place == "Far Away" and got[3].place is None


def test_allocation_finds_the_cheap_depots(spark):
    rows = [(d, p, 1.0 if d % 3 == p else 9.0, 1.0, 5.0) for d in range(12) for p in range(3)]
    df = spark.createDataFrame(rows, "demand long, depot long, cost double, load double, capacity double")
    best = min(allocation.allocate(df, islands=3, generations=80).collect(), key=lambda r: r.cost)
    assert best.cost == 12.0 and best.assignment == [d % 3 for d in range(12)]


def test_perceptron_and_models(spark):
    r = random.Random(0)
    rows = [(x, y, int(x + y > 1), 3 * x - y) for x, y in ((r.random(), r.random()) for _ in range(400))]
    df = spark.createDataFrame(rows, "x double, y double, label int, z double")
    w = learning.perceptron(df, ["x", "y"], "label", rounds=150)
    assert learning.perceptron_predict(df, ["x", "y"], w).where("prediction = label").count() > 380
    m = learning.mlp(df, ["x", "y"], "label")
    assert m.transform(learning.assembled(df, ["x", "y"])).where("prediction = label").count() > 380
    f = learning.forest(df, ["x", "y"], "z")
    assert f.transform(learning.assembled(df, ["x", "y"])).select(F.avg(F.abs(F.col("prediction") - F.col("z")))).first()[0] < 0.2


def png(path, width, height, rgb):
    """A plain picture of one colour, written by hand."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = (b"\0" + bytes(rgb) * width) * height
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pictures(spark, tmp_path):
    for label, rgb in (("fire", (250, 30, 10)), ("calm", (20, 90, 120))):
        (tmp_path / label).mkdir()
        for i in range(3):
            png(tmp_path / label / f"{i}.png", 8, 6, rgb)
    df = files.images(spark, str(tmp_path))
    got = {r.label: r for r in pictures.features(df).collect()}
    assert got["fire"].red_share > 0.8 > 0.2 > got["calm"].red_share and got["fire"].contrast == 0
    before, after = {r.path: r.data for r in df.collect()}, pictures.hazed(df).collect()
    assert len(after) == 6 and all(5 < pictures.psnr(before[r.path], bytes(r.data)) < 30 for r in after)


def test_sources(spark, tmp_path):
    db = str(tmp_path / "cockpit.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE calls (id INTEGER, place TEXT, depth REAL)")
        c.executemany("INSERT INTO calls VALUES (?, ?, ?)", [(i, f"p{i}", None if i == 3 else i / 2) for i in range(25)])
        c.execute("CREATE TABLE none (id INTEGER)")
    spark.dataSource.register(files.SqliteSource)
    read = lambda t: spark.read.format("sqlite").option("path", db).option("table", t).load()
    assert sorted(tuple(r) for r in read("calls").collect()) == sorted(((i, f"p{i}", None if i == 3 else i / 2) for i in range(25)), key=lambda r: r[0])
    assert read("none").collect() == []
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"n": "x"}, "geometry": {"type": "Point", "coordinates": [2.5, 48.0]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}}]}))
    g = files.geojson(spark, str(tmp_path / "a.geojson"))
    p = g.where("kind = 'Point'").select(*files.point(F.col("coordinates"))).first()
    assert tuple(p) == (2.5, 48.0) and g.count() == 2
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2 -9999\n4 5.5 6\n")
    cells = {(r.row, r.col): r.value for r in files.ascii_grid(spark, str(tmp_path / "g.asc")).collect()}
    assert cells == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 4.0, (1, 1): 5.5, (1, 2): 6.0}


def test_gauge_faults_are_found(spark):
    g = files.gauges(spark, 5, 200)
    f = series.quality_flags(g, "gauge", "ts", "rain_mm", 0.0, 200.0, 150.0, 12)
    assert f.where("fault = 'range' AND flag <> 'range'").isEmpty() and f.where("fault = 'missing' AND flag <> 'missing'").isEmpty()


def test_csv_with_a_malformed_line(spark, tmp_path):
    (tmp_path / "edges.csv").write_text("src,dst,length,risk\n1,2,3.5,0.1\n2,x,1.0,0.2\n3,4,,\n5,6\n")
    got = sorted(((r.src, r.dst, r.length, r.bad) for r in files.csv(spark, str(tmp_path / "edges.csv"), files.ROADS).collect()), key=str)
    assert got == sorted([(1, 2, 3.5, None), (2, None, 1.0, "2,x,1.0,0.2"), (3, 4, None, None), (5, 6, None, "5,6")], key=str)
    (tmp_path / "levels.csv").write_text("station,ts,level\na,2024-01-01 00:00:00,1.25\nb,yesterday,2\n")
    one, two = sorted(files.csv(spark, str(tmp_path / "levels.csv"), files.LEVELS).collect(), key=lambda r: r.station)
    assert (one.ts, one.level, one.bad) == (datetime(2024, 1, 1), 1.25, None) and two.ts is None and two.bad == "b,yesterday,2"


def test_forest_finds_what_the_rules_miss(spark):
    g = files.gauges(spark, 12, 600)
    f = series.quality_flags(g, "gauge", "ts", "rain_mm", 0.0, 200.0, 150.0, 12)
    n = {}
    for r in series.model_flags(f, "gauge", "ts", "rain_mm").groupBy("fault", "flag").count().collect():
        n[r.fault, r["flag"]] = r["count"]
    of = lambda fault: sum(v for (a, _), v in n.items() if a == fault)
    assert of("scaled") > 50 and n["scaled", "model"] > 0.8 * of("scaled")
    assert sum(v for (a, b), v in n.items() if a == "none" and b == "model") < 0.05 * of("none")
    wet = f.where("fault = 'stuck' AND rain_mm > 0")  # a dry day is no fault
    assert wet.where("flag = 'stuck'").count() > 0.6 * wet.count() > 0 and sum(v for (a, b), v in n.items() if a == "range" and b == "ok") == 0


def test_field_of_help_requests(spark):
    field, r = tagging.trained(), random.Random(99)
    posts = [tagging.made_post(r) for _ in range(300)]  # others than it has learnt from
    right = sum(a == b for ws, tags in posts for a, b in zip(field.decode(ws), tags))
    assert right > 0.98 * sum(len(t) for _, t in posts)
    for ws, _ in posts[:5]:
        ws = ws[:6]
        score = lambda y: sum(s[t] for s, t in zip(field.scores(ws), y)) + sum(field.move[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        assert abs(score(field.decode(ws)) - max(score(y) for y in itertools.product(range(4), repeat=len(ws)))) < 1e-9
    df = spark.createDataFrame([(1, "Please send water to Bela , 14 of us here"), (2, None), (3, "")], "id long, text string")
    got = {x.id: (x.places, x.needs, x.people) for x in tagging.help_spans(df).collect()}
    assert got == {1: (["Bela"], ["water"], ["14"]), 2: ([], [], []), 3: ([], [], [])}


def test_slope_and_aspect(spark):
    cells = spark.createDataFrame([(r, c, 10.0 * c - 5.0 * r) for r in range(4) for c in range(4)], "row int, col int, value double")
    got = {(x.row, x.col): (x.slope, x.aspect) for x in rasters.slope_aspect(cells, 10.0).collect()}
    assert len(got) == 4
    assert all(s == pytest.approx(math.degrees(math.atan(math.hypot(1.0, 0.5)))) and a == pytest.approx((math.degrees(math.atan2(-1.0, -0.5)) + 360) % 360) for s, a in got.values())


def test_late_events_are_left_out(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    one = spark.createDataFrame([(1, t, 1, "view", 1.0, ""), (2, t + timedelta(hours=30), 1, "view", 1.0, "")], schema)
    two = spark.createDataFrame([(3, t, 1, "view", 1.0, ""), (2, t + timedelta(hours=30), 1, "view", 1.0, "")], schema)
    between = spark.createDataFrame([(4, t + timedelta(hours=31), 1, "view", 1.0, "")], schema)
    for i, df in enumerate((one, between, two)):  # the stream takes files by the time of their last change
        df.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i * 100,) * 2)
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    got = sorted(r.event_id for r in monitor.finished(monitor.distinct(stream), "append").collect())
    assert got == [1, 2, 4]  # event 3 comes 29 hours behind the watermark, which counts from the batch after next


def test_streams_of_a_folder_and_updates_by_key(spark, tmp_path):
    """events.parquet as a folder of files, read in several micro-batches: the last row of each key counts."""
    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(minutes=i), i % 3, "view", float(i), "") for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    got = {r.user_id: (r.seen, r.top) for r in monitor.finished(monitor.levels(stream), "update", ["user_id"]).collect()}
    assert got == {u: (10, 27.0 + u) for u in range(3)}
    assert monitor.run(monitor.distinct, "append")(spark, str(tmp_path)).count() == 30
    assert {r.n for r in monitor.run(monitor.sliding, "complete")(spark, str(tmp_path)).collect()} == {30}


def test_communities_end_on_graphs_of_two_sides(spark):
    edges = [(0, 1), (2, 3), (2, 5), (4, 3), (4, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.label for r in graphs.communities(df).collect()}
    near = {n: {b for a, b in edges + [(y, x) for x, y in edges] if a == n} for n in range(6)}

    def step(labels):
        return {n: min(set(v := [labels[b] for b in near[n]]), key=lambda x: (-v.count(x), x)) for n in near}

    older, labels, new = None, {n: n for n in near}, None
    while True:
        new = step(labels)
        if new in (labels, older):
            break
        older, labels = labels, new
    assert got == (new if new == labels else {n: min(new[n], labels[n]) for n in near})
    with pytest.raises(ValueError, match="negative"):
        graphs.shortest_paths(spark.createDataFrame([(0, 1, -1.0, 0.0)], "src long, dst long, length double, risk double"), spark.createDataFrame([(0,)], "node long"))


def test_recurrent_networks_beat_the_last_value(spark):
    t, r = datetime(2024, 1, 1), random.Random(3)
    rows = [(s, t + timedelta(hours=i), __import__("math").sin(i / 2.0 + k) + r.gauss(0, 0.02)) for k, s in enumerate("ab") for i in range(400)] + [("short", t, 1.0), ("short", t, None)]
    got = {(r.station, r.model): r.rmse for r in recurrent.forecast(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), "k", "ts", "v").collect()}
    assert len(got) == 6 and all(got[s, m] < 0.5 * got[s, "last value"] for s in "ab" for m in ("rnn", "lstm"))


def test_recurrent_gradients():
    import numpy as np

    g = np.random.default_rng(0)
    x, y = g.normal(size=(5, 6)), g.normal(size=5)
    for kind in ("rnn", "lstm"):
        p = recurrent.fit(kind, x, y)
        loss = lambda: 0.5 * float(np.mean((recurrent._forward(kind, p, x)[0] - y) ** 2))  # noqa: E731, B023
        got, kept = recurrent._forward(kind, p, x)
        grad = recurrent._gradient(kind, p, x, kept, (got - y) / len(y))
        for k in p:
            at = np.unravel_index(np.argmax(abs(grad[k])), grad[k].shape)
            old = p[k][at]
            p[k][at] = old + 1e-6
            up = loss()
            p[k][at] = old - 1e-6
            down = loss()
            p[k][at] = old
            assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-6 + 1e-4 * abs(grad[k][at])


def test_hooks_and_linear_autoencoder(spark):
    import numpy as np

    df = spark.createDataFrame([([float(i), 2.0 * i, -i * 1.0],) for i in range(20)], "x array<float>")
    twice = inference.model_udf(lambda: lambda a: a * 2, 3)
    assert [list(r[0]) for r in df.select(twice("x")).limit(2).collect()] == [[0.0, 0.0, 0.0], [2.0, 4.0, -2.0]]
    rows = df.select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("c"))
    coded = inference.autoencode(learning.assembled(rows, ["a", "b", "c"]), "features", 1).collect()
    assert all(np.allclose(r.restored, [r.a, r.b, r.c], atol=1e-5) for r in coded)  # the points are on a line
    noisy = inference.noised(spark.createDataFrame([(bytearray([200] * 3000),)], "data binary"), 400).first().noisy
    keep = float(np.prod(1 - np.linspace(1e-4, 0.02, 1000)[:400]))
    assert abs(np.mean(noisy) - np.sqrt(keep) * (200 / 127.5 - 1)) < 0.1 and abs(np.var(noisy) - (1 - keep)) < 0.1


def test_scans_over_ranges_equal_windows(spark):
    """One key in eight ranges beside small ones, nulls among keys and values: as-of, rules and repair as plain windows have them."""
    from pyspark.sql.window import Window

    from aidlake.operators import scan

    r, start = random.Random(2), datetime(2024, 1, 1)
    rows = [("hot", start + timedelta(minutes=i), r.choice([None, 1.0, 1.0, 5.0, 90.0])) for i in range(800)]
    rows += [("hot", start + timedelta(minutes=800 + i), 7.0) for i in range(400)]  # one run over several ranges
    rows += [(k, start + timedelta(minutes=i), r.choice([None, 2.0, 3.0])) for k in ("a", "b", None) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double").repartition(5)
    parts = scan.segmented(df, ["k"], ["ts"], segments=8)
    assert parts.where("k = 'hot'").select("segment").distinct().count() >= 7
    w = Window.partitionBy("k").orderBy("ts")
    up, rest = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    got = scan.scanned(parts, ["k"], ["ts"], back={"b": F.col("v")}, before={"p": F.struct("v")}, ahead={"a": F.col("v")}, sums={"s": F.col("v")}).drop("segment")
    want = df.select("*", F.last("v", True).over(up).alias("b"), F.lag(F.struct("v")).over(w).alias("p"), F.first("v", True).over(rest).alias("a"), F.sum("v").over(up).alias("s"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    runs = df.withColumn("_new", F.when(F.col("v").eqNullSafe(F.lag("v").over(w)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(up)).withColumn("n", F.count("*").over(Window.partitionBy("k", "_run")))
    flag = F.when(F.col("v").isNull(), "missing").when((F.col("v") < 0) | (F.col("v") > 50), "range").when(F.abs(F.col("v") - F.lag("v").over(w)) > 3, "jump").when((F.col("n") >= 300) & (F.col("v") != 0), "stuck").otherwise("ok")
    flagged = series.quality_flags(df, "k", "ts", "v", 0.0, 50.0, 3.0, 300, segments=8)
    assert sorted(map(str, flagged.collect())) == sorted(map(str, runs.select("k", "ts", "v", flag.alias("flag")).collect()))
    assert flagged.where("flag = 'stuck'").count() >= 399
    fixed = {(x.k, x.ts): x.repaired for x in series.repair(flagged, "k", "ts", "v", segments=8).collect()}
    assert fixed == {(x.k, x.ts): x.repaired for x in series.repair(flagged, "k", "ts", "v", segments=1).collect()}
    left, right = df.where("minute(ts) % 7 = 0"), df.where("v = 5").select("k", "ts", F.col("v").alias("x"), F.unix_seconds("ts").alias("at"))
    one, many = (sorted(map(str, series.asof_join(left, right, "ts", "k", ["x", "at"], segments=n).collect())) for n in (1, 8))
    assert one == many and any("at_asof=None" not in x for x in one)


def test_points_in_polygons_against_all_pairs(spark):
    """Polygons of all sizes with holes, points on corners and edges, and outside of everything."""
    r = random.Random(6)

    def inside(rings, x, y):
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
                if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return True
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
        return odd

    shapes = {}
    for i in range(60):
        cx, cy, size = r.randrange(-150, 150), r.randrange(-70, 70), r.choice([0.01, 0.5, 4, 20, 60 if abs(r.random()) < 0.3 else 2])
        ring = [[float(max(-180, min(180, cx + r.uniform(-size, size)))), float(max(-90, min(90, cy + r.uniform(-size, size))))] for _ in range(r.randrange(3, 9))]
        shapes[i] = [ring] if i % 2 else [ring, [[cx + (x - cx) / 3, cy + (y - cy) / 3] for x, y in ring]]
    shapes[100] = [[[-180.0, -90.0], [180.0, -90.0], [180.0, 90.0], [-180.0, 90.0], [-180.0, -90.0]], [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]]
    points = [(float(r.randrange(-180, 181)), float(r.randrange(-90, 91))) for _ in range(500)] + [tuple(p) for s in shapes.values() for ring in s for p in ring]
    points += [(0.0, 5.0), (5.0, 5.0), (180.0, 90.0), (-180.0, -90.0), (None, 1.0), (200.0, 1.0), (float("nan"), 0.0)]
    places = spark.createDataFrame([(i, x, y, "k") for i, (x, y) in enumerate(points)], "i int, lon double, lat double, level string")
    polygons = spark.createDataFrame([*shapes.items(), (200, None), (201, []), (202, [[]])], "polygon int, rings array<array<array<double>>>")
    got = sorted((p.i, p.polygon) for p in spatial.points_in_polygons(places, polygons).collect())
    ok = [(i, x, y) for i, (x, y) in enumerate(points) if x is not None and abs(x) <= 180]
    assert got == sorted((i, k) for i, x, y in ok for k, s in shapes.items() if inside(s, x, y))
    assert spatial.points_in_polygons(places, polygons.where("polygon > 199")).collect() == []
    cells = spatial.covered(polygons, "polygon", "rings").groupBy("id").agg(F.count("*").alias("n"), F.max("level").alias("level"), F.count_if("sure").alias("sure")).collect()
    assert max(c.n for c in cells) <= spatial.SIDE**2 and len({c.level for c in cells}) > 3 and sum(c.sure for c in cells) > 5


def test_polygons_of_geojson_text(spark):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]
    rows = [(1, "Polygon", json.dumps(square)), (2, "MultiPolygon", json.dumps([square, [[[10, 10], [11, 10], [11, 11], [10, 10]]]])), (3, "Point", "[1, 2]"), (4, None, None)]
    shapes = spark.createDataFrame(rows, "polygon int, kind string, coordinates string").select("polygon", spatial.rings(F.col("kind"), F.col("coordinates")).alias("rings"))
    points = spark.createDataFrame([(0, 3.0, 3.0), (1, 1.5, 1.5), (2, 1.0, 1.5), (3, 10.6, 10.3)], "i int, lon double, lat double")
    assert sorted((p.i, p.polygon) for p in spatial.points_in_polygons(points, shapes).collect()) == [(0, 1), (0, 2), (2, 1), (2, 2), (3, 2)]


def test_places_and_shapes_that_recur_are_tested_once(spark, monkeypatch):
    square = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]]
    polygons = spark.createDataFrame([(i if i else None, square) for i in range(40)], "polygon int, rings array<array<array<double>>>")
    points = spark.range(600).select("id", (F.col("id") % 3).cast("double").alias("lon"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(3.0).alias("lat"))
    written, rows = spatial.table, {}

    def counted(df, name):
        t = written(df, name)
        rows[name] = t.count()
        return t

    monkeypatch.setattr(spatial, "table", counted)
    got = spatial.points_in_polygons(points, polygons)
    assert got.count() == 600 * 40 and got.where("polygon is null").count() == 600
    assert rows["places"] == 6 and rows["shapes"] == 1 and rows["cells"] <= spatial.SIDE**2


def test_misspelt_places_against_all_pairs(spark):
    r, letters = random.Random(9), "abc"

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = {"".join(r.choice(letters) for _ in range(r.randrange(0, 12))) for _ in range(150)}
    names = {"".join(r.choice(letters) for _ in range(r.randrange(1, 12))) for _ in range(60)}
    for n in list(names):
        for _ in range(6):
            w = list(n)
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w) + 1) : r.randrange(len(w) + 1)] = r.choice(["", "a", "b"])
            words.add("".join(w))
    most = lambda n: 2 if len(n) >= 8 else 1 if len(n) >= 5 else 0
    got = gazetteer.matches(spark.createDataFrame([(w,) for w in words], "mention string"), spark.createDataFrame([(n,) for n in names], "name string"))
    want = sorted((w, n, edits(w, n)) for w in words for n in names if edits(w, n) <= most(n))
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 100


def test_posts_are_located(spark):
    places = spark.createDataFrame([("Green Valley", 1.0, 2.0), ("Riverton", 3.0, 4.0), ("Rivertown", 5.0, 6.0), ("Lima", 7.0, 8.0), (None, 0.0, 0.0), ("", 0.0, 0.0)], "place string, lat double, lon double")
    rows = [(1, "help, Gren Vally is under water", "x"), (2, "RIVERTON bridge gone", "x"), (3, "rivertwn!", None), (4, "lims", "x"), (5, None, "x"), (6, "", "x"), (None, "Lima", "x"), (7, "Lima and Riverton", "x"), (7, "Lima and Riverton", "y")]
    got = gazetteer.located(spark.createDataFrame(rows, "post int, text string, name string"), places, "post", "text").collect()
    assert sorted(((g.post, g.place, g.distance) for g in got), key=str) == sorted([(1, "Green Valley", 2), (2, "Riverton", 0), (3, "Rivertown", 1), (4, None, None), (5, None, None), (6, None, None), (None, None, None), (7, "Riverton", 0), (7, "Riverton", 0)], key=str)
    assert got[0].asDict().keys() == {"post", "text", "name", "place", "lat", "lon", "distance"}


def test_tiles_meet_as_cells_do(spark):
    """Negative places, holes, NaN, repeated cells and every tile side give what a plain walk over the cells gives."""
    r = random.Random(4)
    at = {(y, x): float(r.randrange(40)) for y in range(-7, 13) for x in range(-5, 16) if r.random() < 0.9}
    rows = [(y, x, v) for (y, x), v in at.items()] + [(40, 40, None), (41, 41, float("nan")), (None, 1, 1.0)]
    first = next(iter(at))
    rows[0] = (*first, at[first] - 1)
    rows.append((*first, at[first] + 1))
    df = spark.createDataFrame(rows, "row int, col int, value double")
    step = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]

    def lower(y, x):
        drops = [((at[y, x] - at[y + a, x + b]) / (math.sqrt(2) if a and b else 1), (y + a, x + b)) for a, b in step if (y + a, x + b) in at]
        best = max((d for d, _ in drops), default=0)
        return next(p for d, p in drops if d == best) if best > 0 else None

    flow = dict.fromkeys(at, 0)
    for p in at:
        while p:
            flow[p] += 1
            p = lower(*p)
    near = {p: [at[q] for a in range(-2, 3) for b in range(-2, 3) if (q := (p[0] + a, p[1] + b)) in at] for p in at}
    for size in (3, 5, 256):
        assert {(x.row, x.col): x.cells for x in rasters.flow_accumulation(df, size).collect()} == flow
        got = {(x.row, x.col): x.value for x in rasters.focal_mean(df, 2, size).collect()}
        assert got.keys() == at.keys() and all(got[p] == pytest.approx(sum(n) / len(n)) for p, n in near.items())
    assert not rasters.flow_accumulation(df.limit(0), 4).collect() and not rasters.focal_mean(df.limit(0)).collect()
    with pytest.raises(ValueError, match="radius"):
        rasters.focal_mean(df, 4, 3)


def test_a_river_through_many_tiles(spark):
    """One way of 400 cells back and forth over tiles of four: each cell has all before it."""
    way = [(y, x if y % 4 == 0 else 19 - x) for y in range(0, 40, 2) for x in range(20)]
    links = [(y + 1, 19 if y % 4 == 0 else 0) for y in range(0, 38, 2)]
    path = [p for i in range(20) for p in way[20 * i : 20 * i + 20] + links[i : i + 1]]
    # At a turn water takes the corner, two steps down at once, so a cell or two are passed by there.
    df = spark.createDataFrame([(y, x, -float(i)) for i, (y, x) in enumerate(path)], "row int, col int, value double")
    got = {(r.row, r.col): r.cells for r in rasters.flow_accumulation(df, 4).collect()}
    last = max(got.values())
    assert got[path[-1]] == last and last >= len(path) - 2 * 20 and [got[p] for p in path[:10]] == list(range(1, 11))


def test_grid_file_by_several_tasks(spark, tmp_path):
    rows = [[r * 7 + c if (r + c) % 5 else -9999 for c in range(7)] for r in range(200)]
    text = "ncols 7\nnrows 200\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n" + "\n".join(" ".join(map(str, r)) + " " for r in rows) + "\n"
    (tmp_path / "a.asc").write_text(text)
    (tmp_path / "b.asc").write_text("ncols 2\r\nnrows 1\r\n 1   -9999\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.ascii_grid(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = {(x.path[-5], x.row, x.col): x.value for x in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {("a", r, c): float(v) for r, line in enumerate(rows) for c, v in enumerate(line) if v != -9999}
    assert got == want | {("b", 0, 0): 1.0, ("b", 0, 1): -9999.0}


def test_one_sketch_a_task(spark):
    plan = catalog.QUERIES["approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Aggregate(keys=[l_partkey" in line]
    assert keyed and not any("approx_count_distinct" in line for line in keyed)


def test_each_kind_of_customer_is_worded_once(spark, tmp_path):
    """The pleas of customers that repeat one kind, against the wording of every customer; the wording meets a kind's towns, not a customer's."""
    from aidlake.plans import extended

    spark.range(20).selectExpr("id AS s_suppkey", "concat('Supplier', id) AS s_name", "CAST(id % 2 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 2101).selectExpr("id AS c_custkey", "CAST(id % 2 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    found, seen = gazetteer.located, []
    try:
        gazetteer.located = lambda posts, *a: seen.append(posts) or found(posts, *a)
        extended.help_locations(spark, str(tmp_path))
    finally:
        gazetteer.located = found
    want = extended.sql(spark, str(tmp_path), extended.PLEAS.format(c="{customer}", s="{supplier}")).groupBy("c_custkey").agg(F.min("text").alias("text"))
    assert sorted(seen[0].collect()) == sorted(want.collect())
    assert "% 105" in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_follow_the_rows(spark, monkeypatch):
    posts = spark.range(95).selectExpr("id", "'Please send water to Nokville' AS text").coalesce(1)
    monkeypatch.setattr(tagging, "TASK", 10)
    got = tagging.help_spans(posts)
    assert got.rdd.getNumPartitions() == 10 and got.count() == 95
    rows, seen, fit = spark.range(95).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y").coalesce(1), [], learning.GBTRegressor.fit
    monkeypatch.setattr(learning, "TASK", 10)
    monkeypatch.setattr(learning.GBTRegressor, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    assert learning.boosted(rows, ["x"], "y").getNumTrees == 15 and seen == [10]


@pytest.mark.parametrize("odd", [False, True])
def test_nearest_items_meet_in_blocks_and_equal_plain_sums(spark, monkeypatch, odd):
    for name, n in (("QUERIES", 7), ("ITEMS", 40), ("SLICE", 8)):
        monkeypatch.setattr(graphs, name, n, raising=False)
    r = random.Random(6)
    rows = [(i, [float(r.randrange(-3, 4)) / 8 for _ in range(5)]) for i in range(150)] + [(200 + i, [0.5, 0.25, 0.0, 1.0, -1.0]) for i in range(30)]
    if odd:
        rows += [(300, None), (310, []), (320, [1.0, None, 1.0, 1.0, 1.0]), (330, [1.0]), (340, [float("nan")] * 5), (350, [float("inf")] * 5), (None, [1.0] * 5)]
    e = spark.createDataFrame(rows, "id long, v array<float>")
    out = graphs.top_k(e.where("id % 10 = 0"), e, "id", "v", 4)
    q, i = e.where("id % 10 = 0").toDF("query", "q"), e.toDF("item", "i")
    score = F.aggregate(F.zip_with("q", "i", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    want = q.join(i, F.col("query") != F.col("item")).select("query", "item", score.alias("score")).withColumn("place", F.expr("row_number() over (partition by query order by score desc, item)")).where("place <= 4")
    rows = lambda df: sorted(repr(tuple(x)) for x in df.select("query", "item", "score", "place").collect())
    assert rows(out) == rows(want)
    if not odd:
        plan = out._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_features_of_pictures_lie_in_few_files(spark):
    learn, judge = extended.made_pictures(spark, "/root/testdata/sf0.01")
    assert len(learn.inputFiles()) == 1 and learn.count() + judge.count() == 100
    assert learn.unionByName(judge).select("id").distinct().count() == 100


def plain_communities(edges, rounds):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    labels = {n: n for n in near}
    for _ in range(rounds):
        labels = {n: min(set(v := [labels[b] for b in near[n]]), key=lambda x: (-v.count(x), x)) for n in near}
    return labels


@pytest.mark.parametrize("name", [int, "n{:05}".format])
def test_communities_count_packed_votes(spark, monkeypatch, name):
    """Few votes a part, nodes with many edges and names instead of numbers give the labels of plain rounds."""
    monkeypatch.setattr(graphs, "VOTES", 60)
    monkeypatch.setattr(graphs, "HUB", 25)
    r = random.Random(5)
    edges = [(name(r.randrange(90)), name(r.randrange(90))) for _ in range(240)] + [(name(7), name(i)) for i in range(90)]
    df = spark.createDataFrame(edges, f"src {'long' if name is int else 'string'}, dst {'long' if name is int else 'string'}")
    for rounds in (1, 2, 4):
        assert {r.node: r.label for r in graphs.communities(df, rounds).collect()} == plain_communities(edges, rounds)


def test_memory_of_a_part_of_communities():
    """A part that is full, two votes an edge, is counted in some 60 MB beside the votes themselves; so is a batch that is dealt."""
    n, r = 2 * graphs.VOTES, np.random.default_rng(0)
    votes = pa.table({"to": pa.array([0], pa.int32()), **{c: pa.array([r.integers(0, n, n)], pa.list_(pa.int64())) for c in ("src", "label", "n")}})
    batch = pa.RecordBatch.from_pydict({"srcs": pa.array(list(r.integers(0, n, (n // 1000, 500))), pa.list_(pa.int64())), "label": pa.array(r.integers(0, n, n // 1000))})
    for work in (lambda: graphs._choose(votes), lambda: list(graphs._deal(100, np.array([], np.int64))(iter([batch])))):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20


def test_parts_of_communities_follow_the_edges(spark, monkeypatch):
    """What a task sorts and counts is bounded by the number of parts, which grows with the edges."""
    made = []
    monkeypatch.setattr(graphs, "VOTES", 20)
    monkeypatch.setattr(graphs.Bucketed, "append", lambda self, df, old=graphs.Bucketed.append: (made.append((self.n, df.rdd.getNumPartitions())), old(self, df)))
    edges = [(i, i + d) for i in range(100) for d in (1, 2)]
    graphs.communities(spark.createDataFrame(edges, "src long, dst long"), 1).collect()
    assert made == [(10, 10)]
