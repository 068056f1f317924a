"""Queries through the library's operators, with the SQL that must give the same rows where there is one."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..operators import allocation, gazetteer, graphs, learning, linkage, louvain, network, pictures, rasters, recurrent, series, spatial, tagging, texts
from ..sources import files, shared
from ..sources.tables import sql, table
from ..streaming import monitor


def asof_last_purchase(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return series.asof_join(errors, bought, "ts", "user_id", ["purchase"]).select("event_id", F.col("purchase_asof").alias("purchase"))


def percentiles(spark, d: str) -> DataFrame:
    p = series.exact_percentiles(table(spark, d, "events"), "event_type", "value", {"p25": 0.25, "p50": 0.5, "p90": 0.9})
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p90")])


def mad_outliers(spark, d: str) -> DataFrame:
    """Values far from their kind's median, by the median distance from it."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    off = e.join(series.exact_percentiles(e, "event_type", "value", {"med": 0.5}), "event_type").withColumn("off", F.abs(F.col("value") - F.col("med")))
    z = 0.6745 * (F.col("value") - F.col("med")) / F.col("mad")
    return off.join(series.exact_percentiles(off, "event_type", "off", {"mad": 0.5}), "event_type").where(F.abs(z) > 3.5).select("event_id", F.round(z, 6).alias("z"))


def sensor_quality(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return series.quality_flags(e, "user_id", "ts", "value", 1.0, 450.0, 300.0, 4).groupBy("flag").agg(F.count("*").alias("n"))


def sensor_repair(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    flagged = e.withColumn("flag", F.when(F.col("value") > 300, "range").otherwise("ok"))
    return series.repair(flagged, "user_id", "ts", "value").select("event_id", F.round("repaired", 4).alias("repaired"))


def forecast_features(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return series.forecast_features(e, "user_id", "ts", "value", 2, 1).select("event_id", "lag_1", "lag_2", F.round("mean", 6).alias("mean"), "target")


def tfidf(spark, d: str) -> DataFrame:
    return texts.tfidf(table(spark, d, "benchmark"), "item_id", "text").select("id", "term", F.round("weight", 6).alias("weight"))


def embedding_dot(spark, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(geo.dot(F.col("embedding"), F.col("embedding")), 6).alias("squared"))


def embedding_topk(spark, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    out = graphs.top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)
    return out.select("query", "item", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def haversine_pairs(spark, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 3.0 - 30).alias("lat"), (F.col("n_regionkey") * 40.0 - 80).alias("lon"))
    a, b = n.toDF("a", "alat", "alon"), n.toDF("b", "blat", "blon")
    km = geo.haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(km, 4).alias("km"))  # 25 nations


def warning_bands(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 3.0 - 30).alias("lat"), (F.col("c_custkey") % 360 - 180.0).alias("lon"))
    km = geo.haversine(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return c.select("c_custkey", geo.intensity_band(km, F.lit(7.0)).alias("band"))


def roads(spark, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("s"))
    n = p.count()
    steps = F.explode(F.array(F.lit(1), F.lit(17), F.lit(301))).alias("step")
    return p.select("k", "s", steps).select(F.col("k").alias("src"), F.pmod(F.col("k") + F.col("step"), F.lit(n)).alias("dst"), (F.col("s") + F.col("step")).alias("length"), (F.pmod(F.col("k") * 7 + F.col("step"), F.lit(11)) / 10.0).alias("risk"))


def rescue_routes(spark, d: str) -> DataFrame:
    start = spark.range(1).select(F.lit(1).cast("long").alias("node"))
    return graphs.shortest_paths(roads(spark, d), start, 1.0, 1.0).select("node", F.round("cost", 6).alias("cost"))


def supply_graph(spark, d: str) -> DataFrame:
    """Which supplier delivers which part: parts are even nodes, suppliers odd ones."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


def knowledge_communities(spark, d: str) -> DataFrame:
    return graphs.communities(supply_graph(spark, d))


def knowledge_labels(spark, d: str) -> DataFrame:
    return graphs.communities(supply_graph(spark, d), 3)


def knowledge_levels(spark, d: str) -> DataFrame:
    """Communities of the supply graph at several levels, for summaries from the finest to the coarsest."""
    return louvain.louvain(supply_graph(spark, d))


#: A supplier's region, and the region that most deliveries of a part come from, for the nodes of the supply graph.
REGIONS = """
    SELECT s_suppkey * 2 + 1 AS node, n_regionkey AS label FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
    UNION ALL SELECT node, label FROM (SELECT l_partkey * 2 AS node, n_regionkey AS label, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, n_regionkey) AS k
    FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey GROUP BY l_partkey, n_regionkey) t WHERE k = 1"""


def supply_regions(spark, d: str) -> DataFrame:
    """How well the supply graph falls apart into regions."""
    return louvain.modularity(supply_graph(spark, d), sql(spark, d, REGIONS)).select(F.round("modularity", 9).alias("modularity"))


#: Cells along the side of a tile in the queries' small rasters, so that tiles meet there too.
SIDE = 16


def raster_overlay(spark, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).cast("int").alias("row"), (F.col("l_suppkey") % 50).cast("int").alias("col"))
    layers = {"slope": c.agg(F.avg("l_quantity").alias("value")), "rain": c.agg((F.avg("l_discount") * 100).alias("value"))}
    out = rasters.overlay(layers, {"slope": 0.75, "rain": 0.25}, SIDE)
    return rasters.focal_mean(out, size=SIDE).select("row", "col", F.round("value", 6).alias("value"))


def danger_zones(spark, d: str) -> DataFrame:
    """The customers in the zones about suppliers; zones and places follow from the tables' keys, each zone has a hole."""
    zone = table(spark, d, "supplier").selectExpr("s_suppkey", "cast(s_suppkey * 37 % 330 - 165 as double) as cx", "s_nationkey * 3.0D - 30 as cy", "cast(3 + s_suppkey % 9 as double) as r")
    ring = lambda r: F.array(*[F.array(F.col("cx") + i * r, F.col("cy") + j * r) for i, j in ((1, 0), (0, 1), (-1, 0), (0, -1))])
    zone = zone.select("s_suppkey", F.array(ring(F.col("r")), ring(F.col("r") / 2)).alias("rings"))
    at = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_custkey % 360 - 180 as double) as lon", "cast(c_nationkey * 3 - 30 + c_custkey % 5 as double) as lat")
    return spatial.points_in_polygons(at, zone, id_col="s_suppkey").select("c_custkey", "s_suppkey")


def relief_allocation(spark, d: str) -> DataFrame:
    """Nations are demands and depots both: a depot's room is the number of its suppliers, 25 times 25 pairs whatever the scale."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("depot")).agg(F.count("*").cast("double").alias("capacity"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("demand")).agg((F.count("*") / 20.0).alias("load"))
    costs = c.crossJoin(s).withColumn("cost", F.abs(F.col("demand") - F.col("depot")) + 1.0)
    return allocation.allocate(costs)


def _training(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("label"), (F.col("l_extendedprice") > 50_000).cast("int").alias("big"), (F.col("l_extendedprice") / 50_000 - 1).alias("price"))


INPUTS = ["price", "l_discount", "l_tax"]


def confusion(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label, "prediction").agg(F.count("*").alias("n"))


def error(rows: DataFrame) -> DataFrame:
    return rows.select(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).alias("rmse"), F.stddev_pop("label").alias("spread"), F.count("*").alias("n"))


def perceptron_flags(spark, d: str) -> DataFrame:
    """Rows that were held out, by what is so and what the perceptron says."""
    learn, judge = learning.held_out(_training(spark, d))
    return confusion(learning.perceptron_predict(judge, INPUTS, learning.perceptron(learn, INPUTS, "big")), "big")


def network_flags(spark, d: str) -> DataFrame:
    learn, judge = learning.held_out(_training(spark, d))
    return confusion(learning.mlp(learn, INPUTS, "big").transform(learning.assembled(judge, INPUTS)), "big")


def recovery_forest(spark, d: str) -> DataFrame:
    """The error on rows that were held out, beside the labels' own deviation."""
    learn, judge = learning.held_out(_training(spark, d))
    return error(learning.forest(learn, INPUTS, "label").transform(learning.assembled(judge, INPUTS)))


def recovery_boosted(spark, d: str) -> DataFrame:
    learn, judge = learning.held_out(_training(spark, d))
    return error(learning.boosted(learn, INPUTS, "label").transform(learning.assembled(judge, INPUTS)))


def price_network(spark, d: str) -> DataFrame:
    """Classes of price from quantity and unit price, whose product no line follows: held-out rows by class and what is said."""
    bands = F.when(F.col("l_extendedprice") < 20_000, 0).when(F.col("l_extendedprice") < 50_000, 1).otherwise(2)
    x = table(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"), bands.alias("band"))
    learn, judge = learning.held_out(x)
    net = network.fit(learn, ["l_quantity", "unit"], ["band"], [10], classes=3)
    return confusion(judge.withColumn("prediction", F.get(network.predict(net, ["l_quantity", "unit"]), 0).cast("int")), "band")


#: Light that haze adds, as a share of each channel's span.
AIR = 0.9


def haze_autoencoder(spark, d: str) -> DataFrame:
    """Haze of unknown depth taken off five channels by a network with a narrow middle: errors on rows that were held out.

    A row of lineitem is a picture of five channels in 0 to 1; haze mixes all of them with white light, to a share that
    follows from the row's key.
    """
    li = table(spark, d, "lineitem")
    clear = {"a": F.col("l_quantity") / 50, "b": F.col("l_discount") * 10, "c": F.col("l_tax") * 12.5, "d": F.col("l_extendedprice") / 105_000, "e": F.col("l_quantity") * F.col("l_discount") / 5}
    t = 0.4 + F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(60)) / 100.0
    x = li.select(*[c.cast("double").alias(n) for n, c in clear.items()], t.alias("t"))
    x = x.select(*clear, *[(F.col(n) * F.col("t") + AIR * (1 - F.col("t"))).alias(f"hazed_{n}") for n in clear])
    learn, judge = learning.held_out(x)
    seen = [f"hazed_{n}" for n in clear]
    out = judge.withColumn("out", network.predict(network.fit(learn, seen, list(clear), [16, 4, 16]), seen))
    off = lambda of: F.avg(sum((F.pow(of(i, n) - F.col(n), 2) for i, n in enumerate(clear)), F.lit(0.0)) / len(clear))
    return out.agg(F.count("*").alias("n"), off(lambda i, n: F.col(f"hazed_{n}")).alias("hazed"), off(lambda i, n: F.get("out", i)).alias("restored"))


def triage_languages(spark, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("text", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3).cast("double").alias("label"))
    learn, judge = learning.held_out(x)
    return confusion(learning.triage(learn, "text", "label").transform(judge), "label")


def made_pictures(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Features of a picture a supplier: fire by its nation, noise by its balance; (to learn from, to judge by)."""
    of = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 2).cast("int").alias("fire"), (5 + F.pmod(F.abs("s_acctbal").cast("double"), F.lit(45.0))).alias("noise"))
    rows = pictures.features(files.made_pictures(spark, shared.folder(spark, "pictures"), of))
    rows = rows.select(F.regexp_extract("path", r"(\d+)[.]png$", 1).cast("int").alias("id"), (F.col("label") == "fire").cast("int").alias("fire"), "red_share", "brightness", "contrast")
    rows = shared.table(rows.repartition("id"), "features")  # few files, as each round of learning opens them all
    return rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")


def picture_perceptron(spark, d: str) -> DataFrame:
    """Fire in pictures by three features and the perceptron: held-out pictures by what they show and what is said."""
    learn, judge = made_pictures(spark, d)
    names = ["red_share", "brightness", "contrast"]
    return confusion(learning.perceptron_predict(judge, names, learning.perceptron(learn, names, "fire", 200)), "fire")


def picture_network(spark, d: str) -> DataFrame:
    learn, judge = made_pictures(spark, d)
    names = ["red_share", "brightness", "contrast"]
    return confusion(learning.mlp(learn, names, "fire").transform(learning.assembled(judge, names)), "fire")


def gauges(spark, d: str) -> DataFrame:
    """Ten users each as a gauge: the mean value of an hour's events as rain, with faults planted by a hash."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("int")
    e = table(spark, d, "events").groupBy(F.floor(F.col("user_id") / 10).cast("int").alias("g"), hour.alias("h")).agg(F.avg("value").alias("v"))
    return files.gauges(spark, 0, 0, readings=e.select("g", (F.col("h") - 473_000).alias("h"), (F.col("v") / 40).alias("v")))


def rain_gauges(spark, d: str) -> DataFrame:
    g = gauges(spark, d)
    f = series.quality_flags(g, "gauge", "ts", "rain_mm", 0.0, 200.0, 150.0, 12)
    return series.repair(f, "gauge", "ts", "rain_mm").groupBy("fault", "flag").agg(F.count("*").alias("n"), F.round(F.avg("repaired"), 3).alias("mean"))


def rain_gauges_model(spark, d: str) -> DataFrame:
    """Faults by what the rules and the forest together say of them."""
    g = gauges(spark, d)
    f = series.quality_flags(g, "gauge", "ts", "rain_mm", 0.0, 200.0, 150.0, 12)
    return series.model_flags(f, "gauge", "ts", "rain_mm").groupBy("fault", "flag").agg(F.count("*").alias("n"))


#: Posts made of customers: sentences unlike those the field learns from, names it has not seen.
POST = """CASE c_custkey % 3 WHEN 0 THEN concat('Please send ', need, ' to ', town, ', ', CAST(k AS STRING), ' of us wait') WHEN 1 THEN concat(CAST(k AS STRING), ' persons without ', need, ' at ', town, '!')
          ELSE concat('We are trapped near ', town, ', ', CAST(k AS STRING), ' people, need ', need) END"""
TOWN = "concat(upper(substr(n_name, 1, 1)), lower(substr(n_name, 2, 3)), 'ville')"
NEED = "CASE c_custkey % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'food' WHEN 2 THEN 'medicine' ELSE 'blankets' END"


def help_requests(spark, d: str) -> DataFrame:
    made = sql(spark, d, f"""SELECT c_custkey, {POST} AS text FROM (
        SELECT c_custkey, {TOWN} AS town, {NEED} AS need, c_custkey % 90 + 2 AS k FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey) t""")
    return tagging.help_spans(made).select("c_custkey", F.get("places", 0).alias("place"), F.get("needs", 0).alias("need"), F.get("people", 0).cast("int").alias("people"))


#: A town's name follows from its supplier's; posts misspell it with up to three edits, as the customer's key says.
NAMED = "translate(substr(md5(s_name), 1, 9), '0123456789abcdef', 'bakelimonurstdvy')"
SPELT = """CASE c_custkey % 5 WHEN 0 THEN town WHEN 1 THEN concat(substr(town, 1, 3), substr(town, 5)) WHEN 2 THEN concat(substr(town, 1, 2), 'xq', substr(town, 5))
    WHEN 3 THEN concat(substr(town, 2, 6), 'ee', substr(town, 8)) ELSE concat(upper(substr(town, 1, 4)), 'w', substr(town, 5)) END"""
PLEA = """CASE c_custkey % 3 WHEN 0 THEN concat('We are cut off in ', name, ', send boats!') WHEN 1 THEN concat(name, ': no water since noon') ELSE concat('my aunt (', name, ' bridge) needs medicine') END"""
PLEAS = f"SELECT c_custkey, {PLEA} AS text FROM (SELECT c_custkey, {SPELT} AS name FROM (SELECT c_custkey, {NAMED} AS town FROM {{c}} JOIN {{s}} ON s_nationkey = c_nationkey AND s_suppkey % 7 = c_custkey % 7) a) b"

#: A plea follows from its customer's nation and key modulo 3, 5 and 7: a stand-in key, by which each kind of customer is worded once.
KIND = "c_custkey % 105 + 105L * c_nationkey * CASE WHEN c_custkey < 0 THEN -1 ELSE 1 END"


def help_locations(spark, d: str) -> DataFrame:
    """Where posts come from that name a supplier's town, often misspelt."""
    worded = sql(spark, d, PLEAS.format(c=f"(SELECT DISTINCT {KIND} AS c_custkey, c_nationkey FROM {{customer}})", s="{supplier}")).groupBy("c_custkey").agg(F.min("text").alias("text"))
    posts = table(spark, d, "customer").select("c_custkey", F.expr(KIND).alias("kind")).join(worded.withColumnRenamed("c_custkey", "kind"), "kind").groupBy("c_custkey").agg(F.min("text").alias("text"))
    places = sql(spark, d, f"SELECT {NAMED} AS place, s_suppkey % 180 - 90.0D AS lat, s_suppkey * 7 % 360 - 180.0D AS lon FROM {{supplier}}")
    return gazetteer.located(posts, places, "c_custkey", "text").select("c_custkey", "place", "lat", "lon", "distance")


def sqlite_accounts(spark, d: str) -> DataFrame:
    """Customers through a SQLite file in the shared folder: written by tasks, read back by ranges, summed by nation."""
    path = shared.folder(spark, "sqlite").removeprefix("file://").removeprefix("file:")
    spark.dataSource.register(files.SqliteSource)
    kept = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
    kept.write.format("sqlite").option("path", f"{path}.db").option("table", "customers").mode("append").save()
    owed = files.sqlite(spark, f"{path}.db", "customers").where("c_acctbal > 0 and c_nationkey <> 7")
    return owed.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_name").alias("last"), F.round(F.sum("c_acctbal"), 2).alias("total"))


#: A party's name, street and phone follow from its key; a third of the customers stand in a second source, misspelt.
PARTY = """SELECT c_custkey AS k, translate(substr(md5(c_name), 1, 12), '0123456789abcdef', 'bakelimonurstdvy') AS name, translate(substr(md5(concat(c_name, 's')), 1, 10), '0123456789abcdef', 'bakelimonurstdvy') AS street,
    substr(CAST(conv(substr(md5(concat(c_name, 'p')), 1, 12), 16, 10) AS STRING), 1, 9) AS phone FROM {customer}"""
AGAIN = """SELECT k * 2 + 1 AS id, 'registry' AS source, CASE k % 4 WHEN 0 THEN concat(substr(name, 1, 4), substr(name, 6)) WHEN 1 THEN concat('x', name) WHEN 2 THEN concat(substr(name, 1, 7), 'q', substr(name, 9)) ELSE name END AS name,
    CASE WHEN k % 5 = 0 THEN NULL ELSE concat(substr(street, 1, 8), 'w') END AS street, CASE WHEN k % 7 = 0 THEN NULL ELSE concat(substr(phone, 1, 8), '0') END AS phone FROM p WHERE k % 3 = 0"""


def linked_parties(spark, d: str) -> DataFrame:
    """Customers found again in a second source without a key: pairs planted, pairs found, and how many of them are right."""
    parties = sql(spark, d, f"WITH p AS ({PARTY}) SELECT k * 2 AS id, 'desk' AS source, name, street, phone FROM p UNION ALL {AGAIN}")
    keys = [F.col("name"), F.reverse("name"), F.col("phone")]
    found = linkage.linked(parties, "id", {"name": 0.5, "street": 0.2, "phone": 0.3}, keys, 0.8, across="source")
    right = F.count_if((F.col("a") % 2 == 0) & (F.col("b") == F.col("a") + 1))
    return found.agg(F.count("*").alias("found"), right.alias("right")).crossJoin(parties.agg(F.count_if(F.col("source") == "registry").alias("planted")))  # one row each


def csv_roads(spark, d: str) -> DataFrame:
    """Roads through a CSV folder: written, read with declared columns, summed by where they lead."""
    path = shared.folder(spark, "roads")
    roads(spark, d).write.csv(path, header=True)
    r = files.csv(spark, path, files.ROADS)
    return r.groupBy("dst").agg(F.count("*").alias("n"), F.round(F.sum("length"), 4).alias("length"), F.count("bad").alias("bad"))


def props_pairs(spark, d: str) -> DataFrame:
    """Keys and values of events' properties by a table function, summed by kind of event."""
    spark.udtf.register("json_pairs", Pairs)
    return sql(spark, d, "SELECT e.event_type, p.k, count(*) AS n, CAST(sum(p.v) AS BIGINT) AS total FROM {events} e, LATERAL json_pairs(e.props) p GROUP BY e.event_type, p.k")


@F.udtf(returnType=T.StructType().add("k", "string").add("v", "long"))
class Pairs:
    """A row for each key of a JSON object whose value is a whole number."""

    def eval(self, props: str):
        for k, v in json.loads(props or "{}").items():
            if isinstance(v, int):
                yield k, v


@F.pandas_udf(T.DoubleType())
def middle_mean(v: pd.Series) -> float:
    """The mean without the tenth at either end."""
    x = v.dropna().sort_values()
    cut = len(x) // 10
    return float(x.iloc[cut : len(x) - cut].mean())


def trimmed_means(spark, d: str) -> DataFrame:
    """A user's values are one group of a pandas aggregate: bounded by what one user does."""
    return table(spark, d, "events").groupBy("user_id").agg(F.round(middle_mean("value"), 6).alias("mean"))


def heights(spark, d: str) -> DataFrame:
    place = [(F.col(k) % 50).cast("int").alias(n) for k, n in (("l_partkey", "row"), ("l_suppkey", "col"))]
    return table(spark, d, "lineitem").groupBy(*place).agg(F.avg("l_quantity").alias("value"))


def debris_flow(spark, d: str) -> DataFrame:
    """How many cells of the raster drain through each of them."""
    return rasters.flow_accumulation(heights(spark, d), SIDE)


def terrain(spark, d: str) -> DataFrame:
    """Slope and aspect of a raster made of the suppliers' and parts' prices."""
    return rasters.slope_aspect(heights(spark, d), 10.0, SIDE).select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 4).alias("aspect"))


def water_level_networks(spark, d: str) -> DataFrame:
    hourly = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("level"))
    return recurrent.forecast(hourly, "event_type", "hour", "level")


def approx_distinct(spark, d: str) -> DataFrame:
    """The sketch's count is within a tenth of the exact one."""
    # One sketch a task: beside a distinct count Spark would keep one for each key. Copies leave a sketch as it is.
    keys = table(spark, d, "lineitem").select("l_partkey").distinct()
    n = keys.agg(F.count("l_partkey").alias("n"), F.approx_count_distinct("l_partkey", 0.02).alias("about"))
    return n.select("n", (F.abs(F.col("about") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))


def sample(spark, d: str) -> DataFrame:
    return table(spark, d, "orders").sample(0.1, seed=3).select("o_orderkey")


def nvl_distance(expr: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, {expr})))"


_A = "pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)"

QUERIES = {
    f.__name__: f
    for f in (
        asof_last_purchase, percentiles, mad_outliers, sensor_quality, sensor_repair, forecast_features, tfidf, embedding_dot, embedding_topk, haversine_pairs, warning_bands, rescue_routes, danger_zones, knowledge_communities, knowledge_labels,
        knowledge_levels, supply_regions, price_network, haze_autoencoder, linked_parties,
        raster_overlay, relief_allocation, perceptron_flags, network_flags, recovery_forest, recovery_boosted, triage_languages, rain_gauges, water_level_networks, approx_distinct, sample,
        picture_perceptron, picture_network, rain_gauges_model, help_requests, help_locations, csv_roads, sqlite_accounts, props_pairs, trimmed_means, terrain, debris_flow,
    )
} | {
    "stream_tumbling": monitor.run(monitor.tumbling, "complete"),
    "stream_sliding": monitor.run(monitor.sliding, "complete"),
    "stream_sessions": monitor.run(monitor.sessions, "complete"),
    "stream_distinct": monitor.run(monitor.distinct, "append"),
    "stream_followed": monitor.run(monitor.followed, "append"),
    "stream_levels": monitor.run(monitor.levels, "update", ["user_id"]),
    "stream_alerts": monitor.durable(monitor.run(monitor.alerts, "append")),
}

SQL = {
    "asof_last_purchase": "SELECT e.event_id, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts",
    "percentiles": "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type",
    "mad_outliers": """
        WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY event_type),
        d AS (SELECT e.event_type, quantile_cont(abs(e.value - m.med), 0.5) AS mad FROM events e JOIN m ON m.event_type = e.event_type GROUP BY e.event_type)
        SELECT e.event_id, round(0.6745 * (e.value - m.med) / d.mad, 6) AS z FROM events e JOIN m ON m.event_type = e.event_type JOIN d ON d.event_type = e.event_type
        WHERE abs(0.6745 * (e.value - m.med) / d.mad) > 3.5""",
    "sensor_quality": """
        WITH r AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w THEN 0 ELSE 1 END AS fresh, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM r), t AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS size FROM s)
        SELECT CASE WHEN value IS NULL THEN 'missing' WHEN value < 1 OR value > 450 THEN 'range' WHEN abs(value - before) > 300 THEN 'jump' WHEN size >= 4 AND value <> 0 THEN 'stuck' ELSE 'ok' END AS flag, count(*) AS n FROM t GROUP BY 1""",
    "sensor_repair": """
        WITH g AS (SELECT event_id, user_id, ts, value, CASE WHEN value > 300 THEN NULL ELSE value END AS good, CASE WHEN value > 300 THEN NULL ELSE CAST(epoch_us(ts) AS DOUBLE) END AS good_t, CAST(epoch_us(ts) AS DOUBLE) AS t FROM events),
        n AS (SELECT *, last_value(good IGNORE NULLS) OVER b AS v0, last_value(good_t IGNORE NULLS) OVER b AS t0, first_value(good IGNORE NULLS) OVER a AS v1, first_value(good_t IGNORE NULLS) OVER a AS t1 FROM g
              WINDOW b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(CASE WHEN good IS NOT NULL THEN value ELSE coalesce(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE v0 END, v0, v1) END, 4) AS repaired FROM n""",
    "forecast_features": """
        SELECT event_id, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean, lead(value, 1) OVER w AS target
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
    "tfidf": r"""
        WITH t AS (SELECT item_id AS id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark), f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
        SELECT f.id, f.term, round(f.tf * ln((SELECT count(*) FROM benchmark) / d.df), 6) AS weight FROM f JOIN d USING (term)""",
    "embedding_dot": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squared FROM embeddings",
    "embedding_topk": """
        SELECT query, item, round(score, 6) AS score, place FROM (SELECT q.vec_id AS query, i.vec_id AS item, list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) DESC, i.vec_id) AS place
        FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0) t WHERE place <= 5""",
    "haversine_pairs": f"WITH n AS (SELECT n_nationkey AS k, n_nationkey * 3.0::DOUBLE - 30 AS lat, n_regionkey * 40.0::DOUBLE - 80 AS lon FROM nation) SELECT a.k AS a, b.k AS b, round({nvl_distance(_A.format(a='a.', b='b.'))}, 4) AS km FROM n a JOIN n b ON a.k < b.k",
    "warning_bands": f"""
        WITH c AS (SELECT c_custkey, c_nationkey * 3.0::DOUBLE - 30 AS lat, (c_custkey % 360 - 180)::DOUBLE AS lon, 10.0::DOUBLE AS qlat, 20.0::DOUBLE AS qlon FROM customer), k AS (SELECT c_custkey, {nvl_distance(_A.format(a='', b='q'))} AS km FROM c),
        i AS (SELECT c_custkey, 1.5 * 7 - 3.5 * log10(km + 10) + 3 AS i FROM k) SELECT c_custkey, CASE WHEN i >= 7 THEN 'severe' WHEN i >= 5 THEN 'strong' WHEN i >= 3 THEN 'light' ELSE 'none' END AS band FROM i""",
    "rescue_routes": """
        WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size::DOUBLE AS s FROM part), m AS (SELECT count(*) AS n FROM p),
        e AS (SELECT src, dst, min(length * (1 + risk)) AS w FROM (
            SELECT k AS src, (k + step) % n AS dst, s + step AS length, ((k * 7 + step) % 11) / 10.0::DOUBLE AS risk FROM p, m, unnest([1, 17, 301]) AS t(step)) x WHERE risk < 1.0 GROUP BY ALL),
        r(node, cost) USING KEY (node) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION (
            SELECT e.dst, min(r.cost + e.w) FROM r JOIN e ON e.src = r.node LEFT JOIN recurring.r AS old ON old.node = e.dst GROUP BY e.dst HAVING min(r.cost + e.w) < coalesce(min(old.cost), 1e300)))
        SELECT node, round(cost, 6) AS cost FROM r""",
    "danger_zones": """
        WITH z AS (SELECT s_suppkey, (s_suppkey * 37 % 330 - 165)::DOUBLE AS cx, s_nationkey * 3.0::DOUBLE - 30 AS cy, (3 + s_suppkey % 9)::DOUBLE AS r FROM supplier),
        e AS (SELECT s_suppkey, cx + i1 * r / f AS x1, cy + j1 * r / f AS y1, cx + i2 * r / f AS x2, cy + j2 * r / f AS y2 FROM z, (VALUES (1, 0, 0, 1), (0, 1, -1, 0), (-1, 0, 0, -1), (0, -1, 1, 0)) AS t(i1, j1, i2, j2), (VALUES (1), (2)) AS h(f)),
        c AS (SELECT c_custkey, (c_custkey % 360 - 180)::DOUBLE AS x, (c_nationkey * 3 - 30 + c_custkey % 5)::DOUBLE AS y FROM customer)
        SELECT c_custkey, s_suppkey FROM c, e GROUP BY c_custkey, s_suppkey
        HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1
            OR bool_or((x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) AND x BETWEEN least(x1, x2) AND greatest(x1, x2))""",
    "knowledge_labels": """
        WITH g AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem), e AS (SELECT a AS src, b AS dst FROM g UNION SELECT b, a FROM g),
        r0 AS (SELECT DISTINCT src AS node, src AS label FROM e),
        r1 AS (SELECT src AS node, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k FROM e JOIN r0 ON r0.node = e.dst GROUP BY src, label) t WHERE k = 1),
        r2 AS (SELECT src AS node, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k FROM e JOIN r1 ON r1.node = e.dst GROUP BY src, label) t WHERE k = 1)
        SELECT src AS node, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k FROM e JOIN r2 ON r2.node = e.dst GROUP BY src, label) t WHERE k = 1""",
    "supply_regions": f"""
        WITH g AS (SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem), e AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g),
        r AS ({REGIONS.format(supplier='supplier', nation='nation', lineitem='lineitem')}),
        c AS (SELECT a.label, count(*) AS tot, count(*) FILTER (WHERE a.label = b.label) AS inn FROM e JOIN r a ON a.node = e.src JOIN r b ON b.node = e.dst GROUP BY a.label)
        SELECT round(sum(inn) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 9) AS modularity FROM c""",
    "sqlite_accounts": "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n, max(c_name) AS last, round(sum(CAST(c_acctbal AS DOUBLE)), 2) AS total FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 7 GROUP BY 1",
    "help_requests": f"""
        SELECT c_custkey, {TOWN} AS place, {NEED} AS need, CAST(c_custkey % 90 + 2 AS INTEGER) AS people FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "help_locations": f"""
        WITH p AS (SELECT c_custkey, min(text) AS text FROM ({PLEAS.format(c='customer', s='supplier')}) t GROUP BY c_custkey),
        g AS (SELECT {NAMED} AS place, (s_suppkey % 180 - 90)::DOUBLE AS lat, (s_suppkey * 7 % 360 - 180)::DOUBLE AS lon FROM supplier),
        w AS (SELECT c_custkey, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM p),
        m AS (SELECT c_custkey, unnest(ws) AS mention FROM w UNION SELECT c_custkey, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
        h AS (SELECT u.mention, g.*, levenshtein(u.mention, g.place)::INTEGER AS distance FROM (SELECT DISTINCT mention FROM m) u, g WHERE levenshtein(u.mention, g.place) <= 2),
        b AS (SELECT c_custkey, place, lat, lon, distance, row_number() OVER (PARTITION BY c_custkey ORDER BY distance, place, lat, lon) AS k FROM m JOIN h ON h.mention = m.mention)
        SELECT p.c_custkey, b.place, b.lat, b.lon, b.distance FROM p LEFT JOIN b ON b.c_custkey = p.c_custkey AND b.k = 1""",
    "csv_roads": """
        SELECT (k + step) % n AS dst, count(*) AS n, round(sum(s + step), 4) AS length, 0::BIGINT AS bad FROM (SELECT p_partkey AS k, p_size::DOUBLE AS s FROM part) p, (SELECT count(*) AS n FROM part) m, unnest([1, 17, 301]) AS t(step) GROUP BY 1""",
    "props_pairs": """
        SELECT event_type, k, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.' || k) AS BIGINT)) AS BIGINT) AS total FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events) t GROUP BY event_type, k""",
    "trimmed_means": """
        SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) t
        WHERE k > n // 10 AND k <= n - n // 10 GROUP BY user_id""",
    "debris_flow": """
        WITH RECURSIVE c AS (SELECT CAST(l_partkey % 50 AS INT) AS r, CAST(l_suppkey % 50 AS INT) AS c, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
        n AS (SELECT a.r, a.c, b.r AS tr, b.c AS tc, (a.v - b.v) / CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END AS d
              FROM c a JOIN c b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.v > b.v),
        s AS (SELECT r, c, tr, tc FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d DESC, tr, tc) AS k FROM n) t WHERE k = 1),
        p AS (SELECT r, c FROM c UNION ALL SELECT s.tr, s.tc FROM p JOIN s ON s.r = p.r AND s.c = p.c)
        SELECT r AS row, c AS col, count(*) AS cells FROM p GROUP BY r, c""",
    "terrain": """
        WITH c AS (SELECT CAST(l_partkey % 50 AS INT) AS r, CAST(l_suppkey % 50 AS INT) AS c, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
        g AS (SELECT o.r, o.c, (e.v - w.v) / 20 AS x, (n.v - s.v) / 20 AS y FROM c o JOIN c n ON n.r = o.r - 1 AND n.c = o.c JOIN c s ON s.r = o.r + 1 AND s.c = o.c JOIN c e ON e.r = o.r AND e.c = o.c + 1 JOIN c w ON w.r = o.r AND w.c = o.c - 1)
        SELECT r AS row, c AS col, round(degrees(atan(sqrt(x * x + y * y))), 6) AS slope, CASE WHEN x <> 0 OR y <> 0 THEN round((degrees(atan2(-x, -y)) + 360) % 360, 4) END AS aspect FROM g""",
    "approx_distinct": "SELECT count(DISTINCT l_partkey) AS n, true AS close FROM lineitem",
    "raster_overlay": """
        WITH c AS (SELECT CAST(l_partkey % 50 AS INT) AS r, CAST(l_suppkey % 50 AS INT) AS c, 0.75 * avg(l_quantity) + 0.25 * avg(l_discount) * 100 AS v FROM lineitem GROUP BY 1, 2)
        SELECT a.r AS row, a.c AS col, round(avg(b.v), 6) AS value FROM c a JOIN c b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c""",
    "stream_tumbling": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY, date_trunc('day', ts)::TIMESTAMP]) AS start FROM events) t GROUP BY start",
    "stream_sessions": """
        SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
            SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s""",
    "stream_distinct": "SELECT DISTINCT event_id, user_id FROM events",
    "stream_followed": "SELECT p.event_id AS purchase_id, e.event_id AS error_id FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 1 HOUR WHERE p.event_type = 'purchase' AND e.event_type = 'error'",
    "stream_alerts": """
        WITH e AS (SELECT *, CASE WHEN value > 250 THEN 1 WHEN value < 50 THEN 0 END AS mark, CASE WHEN ts > lag(ts) OVER w + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
        SELECT user_id, event_id, value FROM (SELECT *, lag(mark) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS before FROM s WHERE mark IS NOT NULL) t WHERE mark = 1 AND coalesce(before, 0) = 0""",
    "stream_levels": "SELECT user_id, count(*) AS seen, max(value) AS top, CAST(count(*) FILTER (WHERE value > 400) AS BIGINT) AS alerts FROM events GROUP BY user_id",
}
