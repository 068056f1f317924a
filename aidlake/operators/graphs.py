"""Graphs as vertex and edge tables: risk-aware routing, communities, retrieval."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegralType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.geo import dot
from ..sources.shared import drop, folder, table


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


#: Edges that a task settles by itself in the search for routes.
BLOCK = 500_000


class Bucketed:
    """A table in the shared folder, bucketed by a column: what joins on it moves to its buckets, it stays."""

    def __init__(self, spark: SparkSession, by: str, name: str, n: int | None = None):
        self.spark, self.by, self.path = spark, by, folder(spark, name)
        self.name, self.n = f"{name}_{uuid.uuid4().hex}", n or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, df: DataFrame) -> None:
        df.write.bucketBy(self.n, self.by).sortBy(self.by).mode("append").option("path", self.path).format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def closed(self) -> DataFrame:
        """The rows from their files; the catalogue forgets the table."""
        rows = self.spark.read.schema(self.read().schema).parquet(self.path)
        self.spark.sql(f"DROP TABLE {self.name}")
        return rows


def _settle(limit: float):
    """For a block of edges and the known costs of its nodes: the nodes that become cheaper by paths inside it.

    A heap settles what the fresh nodes (go) reach over the block's edges, as far as costs under the limit. A node stays
    fresh if it has edges elsewhere too, or is dearer than the limit.
    """

    def work(edges: pa.Table, nodes: pa.Table) -> pa.Table:
        ends, n = edges.num_rows, nodes.num_rows
        ids = pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks, *nodes["node"].chunks], edges["src"].type).combine_chunks().dictionary_encode()
        at = ids.indices.to_numpy()
        src, dst, known = at[:ends], at[ends : 2 * ends], at[2 * ends :]
        many = len(ids.dictionary)
        order = np.argsort(src, kind="stable")
        first = np.searchsorted(src[order], np.arange(many + 1)).tolist()
        to, w = dst[order].tolist(), edges["w"].to_numpy()[order].tolist()
        home = np.full(many, edges["block"][0].as_py() if ends else -1)
        home[dst] = edges["to"].to_numpy()
        cost = np.full(many, np.inf)
        cost[known] = nodes["cost"].to_numpy()
        go = nodes["go"].to_numpy(zero_copy_only=False)
        cost, previous = cost.tolist(), [-1] * many
        heap = [(cost[i], i) for i in known[go].tolist()]
        heapify(heap)
        while heap:
            c, i = heappop(heap)
            if c > cost[i]:
                continue
            for e in range(first[i], first[i + 1]):
                j, d = to[e], c + w[e]
                if d < cost[j]:
                    cost[j], previous[j] = d, i
                    if d < limit and first[j] < first[j + 1]:
                        heappush(heap, (d, j))
        got = np.array([i for i in range(many) if previous[i] >= 0], int)
        cost, here = np.array(cost)[got], edges["block"][0].as_py() if ends else -1
        fresh = (home[got] != -1) & ~((home[got] == here) & (cost < limit))
        name = ids.dictionary.take
        return pa.table({"node": name(pa.array(got)), "cost": cost, "previous": name(pa.array(np.array(previous, int)[got])), "fresh": fresh})

    return work


def shortest_paths(edges: DataFrame, sources: DataFrame, risk_weight: float = 1.0, blocked: float = 1.0, max_rounds: int | None = None, delta: float | None = None, trace: list | None = None) -> DataFrame:
    """(node, cost, previous): cheapest routes from the sources over edges(src, dst, length, risk), block by block.

    An edge costs length * (1 + risk_weight * risk); edges with risk >= blocked are closed. Edges are cut by their near
    ends' order into blocks of about BLOCK, also within a node. A round settles each block that has fresh nodes by itself and
    sends what became cheaper to the blocks where it has edges; it ends when nothing is fresh. So there are as many rounds
    as a route changes blocks, which is less the more neighbours stand near each other in the ids' order, and never more than
    a route has edges. With `delta` nodes settle in buckets of so much cost, and the settled are set aside.

    Of routes of equal cost one is named. Negative costs are refused, as a circle of them has no cheapest route. It ends with
    an error after max_rounds if they are given. trace, if given, gets (bucket's limit, open rows, rows that became cheaper)
    of each round.
    """
    spark, kind = edges.sparkSession, sources.schema["node"].dataType
    cost = edges.where(F.col("risk") < blocked).groupBy("src", "dst").agg(F.min(F.col("length") * (1 + risk_weight * F.col("risk"))).alias("w"))
    costs = table(cost.where("src <> dst and w is not null").select(F.col("src").cast(kind), F.col("dst").cast(kind), "w"), "costs")
    least, n = costs.agg(F.min("w"), F.count("*")).first()
    if least is not None and least < 0:
        raise ValueError("an edge has a negative cost")
    cut = table(costs.repartitionByRange(max(1, -(-n // BLOCK)), "src", "dst").withColumn("block", F.spark_partition_id()), "cut")
    drop(costs)
    homes = table(cut.select(F.col("src").alias("node"), "block").distinct(), "homes")
    to = homes.groupBy("node").agg(F.when(F.count("*") == 1, F.min("block")).otherwise(-2).alias("to")).withColumnRenamed("node", "dst")
    known = Bucketed(spark, "block", "edges")
    known.append(cut.join(to, "dst", "left").select("block", "src", "dst", "w", F.coalesce("to", F.lit(-1)).alias("to")))
    drop(cut)
    start = sources.select("node", F.lit(0.0).alias("cost"), F.lit(None).cast(kind).alias("previous"), F.lit(True).alias("fresh")).distinct()
    settled = Bucketed(spark, "node", "settled")
    settled.append(start.drop("fresh").limit(0))
    schema = StructType([StructField("node", kind), StructField("cost", DoubleType()), StructField("previous", kind), StructField("fresh", BooleanType())])
    open_, rounds = table(start, "routes"), 0
    limit = delta = delta or float("inf")
    while True:
        inside = F.col("cost") < limit
        now = open_.agg(F.min("cost").alias("least"), F.count("*").alias("n"), F.count(F.when(F.col("fresh") & inside, 1)).alias("fresh")).first()
        if not now.n:
            known.closed()
            return settled.closed()
        rounds += 1
        if max_rounds and rounds > max_rounds:
            raise ValueError("no end after max_rounds")
        before = open_
        if now.fresh:
            blocks = [r.block for r in before.where("fresh").where(inside).join(homes, "node").select("block").distinct().collect()]  # a number for BLOCK edges at most
            in_, of = F.col("block").isin(blocks), ["block", "node", "cost", "go"]
            there = before.withColumn("go", F.col("fresh") & inside).join(homes.where(in_), "node").select(*of)
            moved = known.read().where(in_).groupBy("block").cogroup(there.groupBy("block")).applyInArrow(_settle(limit), schema)
            if delta < float("inf"):
                moved = moved.join(settled.read().select("node"), "node", "left_anti")
            moved = table(moved, "moved")
            if trace is not None:
                trace.append((limit, now.n, moved.count()))
            both = before.withColumn("fresh", F.col("fresh") & ~inside).unionByName(moved)
            # At equal cost the old entry wins, as false comes before true.
            open_ = table(both.groupBy("node").agg(F.min(F.struct("cost", "fresh", "previous")).alias("m")).select("node", "m.cost", "m.previous", "m.fresh"), "routes")
            drop(moved)
        elif now.least < limit:
            settled.append(before.where(inside).drop("fresh"))
            open_ = table(before.where(~inside), "routes")
        else:
            limit = (now.least // delta + 1) * delta
            limit = limit if limit > now.least else float("inf")  # a width beneath the numbers' precision
            continue
        drop(before)


#: Edges whose ends vote in a task at a time, and those of a node from which on its votes are spread over the tasks by label.
VOTES = HUB = 250_000
#: Neighbours in a row of the written graph.
CHUNK = 1024
DEALT = "to int, src array<bigint>, label array<bigint>, n array<bigint>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dst, srcs) of up to CHUNK neighbours from edges(src, dst) in the order of dst."""
    for b in batches:
        src, dst = b.column("src"), b.column("dst").to_numpy()
        first = np.union1d(np.flatnonzero(dst[1:] != dst[:-1]) + 1, np.arange(0, len(dst), CHUNK))
        yield pa.RecordBatch.from_arrays([pa.array(dst[first]), pa.ListArray.from_arrays(np.append(first, len(dst)).astype(np.int32), src)], ["dst", "srcs"])


def _deal(parts: int, hubs: np.ndarray):
    """For rows (srcs, label): the number of votes for each label that each of srcs has here, packed by the part that counts them."""

    def dealt(src: np.ndarray, size: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        names, label = np.unique(label, return_inverse=True)
        least, ids = int(src.min()), None
        if (int(src.max()) - least + 1) * len(names) >= 1 << 63:
            ids, src = np.unique(src, return_inverse=True)
            least = 0
        key = np.sort((src - least) * len(names) + np.repeat(label, size))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(first, len(key)))
        src, label = key[first] // len(names) + least, names[key[first] % len(names)]
        src = src if ids is None else ids[src]
        spread = mixed(src.view(np.uint64)) ^ np.where(np.isin(src, hubs), mixed(~label.view(np.uint64)), np.uint64(0))
        to = ((mixed(spread) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        at = np.searchsorted(to[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(at))
        ends = pa.array(np.append(at[some], len(to)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (src, label, n))], ["to", "src", "label", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                srcs = b.column("srcs")
                held.append((srcs.flatten().to_numpy(), srcs.value_lengths().to_numpy(), b.column("label").to_numpy()))
                n += len(held[-1][0])
            if n >= VOTES:
                yield dealt(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield dealt(*map(np.concatenate, zip(*held, strict=True)))

    return work


def _choose(votes: pa.Table) -> pa.Table:
    """The label with the most votes of each node, ties to the least, and that number."""
    src, label, n = (votes[c].combine_chunks().flatten().to_numpy() for c in ("src", "label", "n"))
    order = np.lexsort((label, src))
    src, label, n = src[order], label[order], n[order]
    first = np.flatnonzero(np.append(True, (src[1:] != src[:-1]) | (label[1:] != label[:-1])))
    src, label, n = src[first], label[first], np.add.reduceat(n, first)
    start = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
    most = np.maximum.reduceat(n, start)
    best = np.flatnonzero(n == np.repeat(most, np.diff(np.append(start, len(src)))))
    best = best[np.searchsorted(best, start)]
    return pa.table({"node": src[start], "label": label[best], "n": most})


def communities(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label): label propagation over undirected edges(src, dst): each round the commonest label, ties to the least.

    Rounds go on until no label changes, or until the labels are those of two rounds before, as on graphs of two
    sides; then a node gets the lesser of its two labels. With `rounds` given there are so many at most.

    The graph is written once as lists of neighbours, bucketed by node, and stays there. A round brings the labels to the
    lists; tasks count the votes of about VOTES edges at a time and send them, packed, to the parts that own the nodes that
    they are for, and as many parts there are as the edges need. Votes for a node of more than HUB edges are spread over the parts
    by label. In the first round all labels differ, so the least neighbour wins.
    """
    spark = edges.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // VOTES))
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).repartition(parts, "src", "dst").distinct()
    kind, names = pairs.schema["src"].dataType, None
    if not isinstance(kind, IntegralType):  # numbers in the nodes' order take their place
        pairs = table(pairs, "named")
        nodes = pairs.select(F.col("src").alias("name")).unionByName(pairs.select(F.col("dst").alias("name"))).distinct()
        names = table(nodes.repartitionByRange(parts, "name").sortWithinPartitions("name").withColumn("id", F.monotonically_increasing_id()), "names")
        pairs = pairs.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    pairs = table(pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")), "edges")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = Bucketed(spark, "dst", "neighbours", parts)
    near.append(both.repartition(parts, "dst").sortWithinPartitions("dst").mapInArrow(_packed, "dst bigint, srcs array<bigint>"))
    drop(pairs)
    start = near.read().groupBy("dst").agg(F.min(F.array_min("srcs")).alias("label"), F.sum(F.size("srcs")).alias("n"))
    new = table(start.select(F.col("dst").alias("node"), "label", "n"), "labels")
    hubs = [r.node for r in new.where(F.col("n") > HUB).select("node").collect()]  # two for HUB edges at most
    deal, new = _deal(parts, np.array(hubs, np.int64)), new.drop("n")
    older, labels = None, new.select("node", F.col("node").alias("label"))
    for n in count(1):
        if n > 1:
            lists = near.read().join(labels.hint("shuffle_hash"), F.col("dst") == F.col("node")).select("srcs", "label")
            chosen = lists.mapInArrow(deal, DEALT).repartition(parts, "to").groupBy("to").applyInArrow(_choose, "node bigint, label bigint, n bigint")
            if hubs:
                spread, chosen = F.col("node").isin(hubs), table(chosen, "chosen")
                of_hubs = chosen.where(spread).groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
                chosen = chosen.where(~spread).select("node", "label").unionByName(of_hubs)
            new = table(chosen.select("node", "label"), "labels")
        if n == rounds or _same(new, labels):
            break
        if older is not None:
            if _same(new, older):
                new = table(new.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
                break
            if n > 2:
                drop(older)
        older, labels = labels, new
    drop(near.closed())
    if names is not None:
        return new.join(names.toDF("node_name", "node"), "node").join(names.toDF("label_name", "label"), "label").select(F.col("node_name").alias("node"), F.col("label_name").alias("label"))
    return new.select(F.col("node").cast(kind), F.col("label").cast(kind))


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.join(b, ["node", "label"], "left_anti").isEmpty()


#: Queries and items that meet in one task, and those whose products a task holds at a time.
QUERIES, ITEMS, SLICE = 20_000, 100_000, 1024


def _best(k: int, dim: int):
    """For the queries and items of a task: each query's k items of the largest dot product, ties to the smaller id.

    Products of matrices choose what may be among them; these few are summed once more in the vectors' order, as dot() does.
    """

    def work(queries: pa.Table, items: pa.Table) -> pa.Table:
        out = {"query": [], "item": [], "score": []}
        if queries.num_rows and items.num_rows:
            ids = pa.chunked_array([*queries["query"].chunks, *items["item"].chunks]).combine_chunks().dictionary_encode()
            code = np.argsort(pc.sort_indices(ids.dictionary).to_numpy())[ids.indices.to_numpy()]
            q_id, i_id = code[: queries.num_rows], code[queries.num_rows :]
            x, y = (t[c].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, dim) for t, c in ((queries, "_q"), (items, "_i")))
            long = np.sqrt((y * y).sum(1)).max() * dim * 1e-15
            found = []
            for lo in range(0, len(x), SLICE):
                xs, qs = x[lo : lo + SLICE], q_id[lo : lo + SLICE]
                off = (np.sqrt((xs * xs).sum(1)) * long)[:, None]  # more than either sum's rounding
                row, item, score = np.empty(0, int), np.empty(0, int), np.empty(0)
                least = np.full((len(xs), 1), -np.inf)
                for at in range(0, len(y), SLICE):
                    ys, own = y[at : at + SLICE], i_id[at : at + SLICE]
                    about = xs @ ys.T
                    if len(own) > k + 1:  # the query itself may be one of them
                        least = np.maximum(least, np.partition(about, -k - 1, axis=1)[:, -k - 1 : -k] - off) if not at else least
                    r, c = np.nonzero(about >= least - off)
                    r, c = (v[qs[r] != own[c]] for v in (r, c))
                    exact = np.zeros(len(r))
                    for d in range(dim):
                        exact += xs[r, d] * ys[c, d]
                    row, item, score = np.append(row, r), np.append(item, own[c]), np.append(score, exact)
                    order = np.lexsort((item, -score, row))
                    row, item, score = row[order], item[order], score[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    row, item, score, place = (v[place < k] for v in (row, item, score, place))
                    least[row[place == k - 1], 0] = score[place == k - 1]
                found.append((qs[row], item, score))
            names = ids.dictionary.take(pc.sort_indices(ids.dictionary))
            q, i, score = map(np.concatenate, zip(*found, strict=True))
            out = {"query": names.take(pa.array(q)), "item": names.take(pa.array(i)), "score": score}
        return pa.table({"query": pa.array(out["query"], queries["query"].type), "item": pa.array(out["item"], items["item"].type), "score": pa.array(out["score"], pa.float64())})

    return work


def top_k(queries: DataFrame, items: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(query, item, score, place): the k items with the largest dot product for each query; ties to the smaller id.

    Every query meets every item, in a grid of tasks of QUERIES by ITEMS that give k rows a query. Vectors that are null or
    empty, hold null, huge or non-finite components or are not as long as most have the scores that dot() gives them, row by row.
    """
    q = queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("_q")).where("query is not null")
    i = items.select(F.col(id_col).alias("item"), F.col(vec_col).alias("_i")).where("item is not null")
    plain = lambda v: F.coalesce(F.forall(v, lambda e: F.abs(e) < 1e100), F.lit(False)) & (F.size(v) > 0)
    sizes = lambda t, v: {r[0]: r[1] for r in t.groupBy(F.when(plain(F.col(v)), F.size(v)).alias("d")).count().collect()}
    nq, ni = sizes(q, "_q"), sizes(i, "_i")  # a number a length
    dim = max((d for d in ni if d), key=lambda d: (ni[d], -d), default=0)
    good = lambda v: plain(F.col(v)) & (F.size(v) == dim)
    a, b = max(1, -(-ni.get(dim, 0) // ITEMS)), max(1, -(-nq.get(dim, 0) // QUERIES))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qs = q.where(good("_q")).select(part("query", b).cast("int").alias("b"), each(a).alias("a"), "*")
    is_ = i.where(good("_i")).select(part("item", a).cast("int").alias("a"), each(b).alias("b"), "*")
    schema = StructType([StructField("query", q.schema["query"].dataType), StructField("item", i.schema["item"].dataType), StructField("score", DoubleType())])
    scored = qs.groupBy("a", "b").cogroup(is_.groupBy("a", "b")).applyInArrow(_best(k, dim), schema)
    odd_q, odd_i = (sum(n.values()) > n.get(dim, 0) for n in (nq, ni))
    by_row = lambda qs, is_: is_.join(qs, F.col("query") != F.col("item")).select("query", "item", dot(F.col("_q"), F.col("_i")).alias("score"))
    if odd_q:
        scored = scored.unionByName(by_row(q.where(~good("_q")), i))
    if odd_i:
        scored = scored.unionByName(by_row(q.where(good("_q")), i.where(~good("_i"))))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
