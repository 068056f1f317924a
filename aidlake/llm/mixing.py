"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_name, written

#: Documents that one block rounds, and residuals that one node of the reduction tree combines.
BLOCK, FAN_IN = 4096, 64
#: Fractions this close to 0 or 1 are whole.
TINY = 1e-9

WORDS = r"[^\x20\x09-\x0D]+"


def ranked_sources(rows: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, rank): sources by code point, null last; no task sees all sources."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    placed = written(totals.orderBy(F.asc_nulls_last("source")).withColumn("mid", F.monotonically_increasing_id()), "sources")
    part, base, before = F.shiftright("mid", 33), [], 0
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        base += [F.lit(p), F.lit(before)]
        before += n
    offset = F.element_at(F.create_map(*base), part) if base else F.lit(0)
    return placed.withColumn("rank", offset + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("mid")


def targets(sources: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """sources and target: the total shared by weight, no target above most times its source, the excess reshared.

    Sharing again until none is above ends at one level: target = min(level * weight, most * size). Each round
    moves sources that are above to their bound; the driver sees three sums a round.
    """
    s = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    bound, level, count = most * F.col("source_size"), -1.0, -1
    while True:
        above = bound < level * F.col("w") if count >= 0 else F.lit(False)
        total, held, free, n = s.agg(F.sum("source_size"), F.sum(F.when(above, bound)), F.sum(F.when(~above, F.col("w"))), F.count(F.when(above, 1))).first()
        if n == count:
            break
        level, count = ((total or 0) - (held or 0)) / free if free else 0.0, n
    return s.withColumn("target", F.least(F.lit(level) * F.col("w"), bound)).drop("w")


def pivot(rows: DataFrame, by: list[str], seed: int) -> DataFrame:
    """rows with extra (int) and open: each group's fractions p rounded to 0 or 1 but for one row at most.

    Two open rows trade words, not counts: mass d moves from one to the other as d / size, in one of two
    directions that are drawn so that no p changes in expectation, until one p is 0 or 1. So the group's words
    stay as they were. Rows come largest first, which leaves a small document open. A task holds one open row.
    """
    ordered = rows.repartition(*by).sortWithinPartitions(*by, F.desc("size"), "tie")
    schema = T.StructType([f for f in rows.schema if f.name != "p"]).add("p", "double").add("extra", "integer").add("open", "boolean")
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, p, size, rng = None, None, 0.0, 0, random.Random()

        def closed(row: pa.RecordBatch, p: float, end: bool = False) -> pa.RecordBatch:
            whole = p <= TINY or p >= 1 - TINY
            new = {"p": pa.array([p]), "extra": pa.array([int(p > 0.5) if whole else 0], pa.int32()), "open": pa.array([end and not whole])}
            return pa.RecordBatch.from_arrays([new[n] if n in new else row.column(row.schema.get_field_index(n)) for n in names], names)

        for b in batches:
            ps, sizes, keys = b.column("p").to_pylist(), b.column("size").to_pylist(), list(zip(*(b.column(c).to_pylist() for c in by), strict=True))
            ready = [None] * len(ps)  # of this batch's rows
            own = None  # place of the held row if it is in this batch
            for i, (q, s, k) in enumerate(zip(ps, sizes, keys, strict=True)):
                if k != group:
                    if held is not None:
                        if own is None:
                            yield closed(held, p, True)
                        else:
                            ready[own] = (p, True)
                    group, held, own = k, None, None
                    rng = random.Random(f"{seed}/{k}")
                if s == 0:
                    q = float(rng.random() < q)  # no words: any rounding keeps them
                if q <= TINY or q >= 1 - TINY:
                    ready[i] = (q, False)
                    continue
                if held is None:
                    held, own, p, size = b.slice(i, 1), i, q, s
                    continue
                up, down = min((1 - p) * size, q * s), min(p * size, (1 - q) * s)
                d = up if rng.random() * (up + down) < down else -down
                p, q = p + d / size, q - d / s
                if q <= TINY or q >= 1 - TINY:
                    ready[i] = (q, False)
                else:  # the held row is whole now; this one is held
                    if own is None:
                        yield closed(held, p)
                    else:
                        ready[own] = (p, False)
                    held, own, p, size = b.slice(i, 1), i, q, s
            done = [i for i, r in enumerate(ready) if r is not None]
            if done:
                rest = b.take(pa.array(done))
                values = [ready[i] for i in done]
                new = {"p": pa.array([v[0] for v in values], pa.float64()), "extra": pa.array([int(v[0] > 0.5 and not v[1]) for v in values], pa.int32()), "open": pa.array([v[1] for v in values])}
                yield pa.RecordBatch.from_arrays([new[n] if n in new else rest.column(rest.schema.get_field_index(n)) for n in names], names)
        if held is not None:
            yield closed(held, p, True)

    return ordered.mapInArrow(work, schema)


def mix(df: DataFrame, source_col: str = "source", size_col: str = "size", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """df with source_size (long), target (double), copies (int) and taken (long, copies * size).

    Sources by code point, null last, get weights in turn. A document's expected copies are target / source size;
    the whole part is taken, the fraction is rounded by pivotal sampling in blocks of a source (a hot source has
    many), and what each block leaves open goes up a reduction tree with FAN_IN residuals a node. At its root one
    document a source is drawn. A source's words so miss its target by less than one (small) document.

    A null size counts as 0; a document of size 0 has no words to take and gets its whole part and a draw. Ties
    and repeated rows are separate documents; equal rows may differ in copies, as many as there are get the same
    multiset on every run. Draws depend on seed, source and block alone, so reruns agree. An empty table gives
    none. Other columns are passed on, whatever their names (the four result columns are replaced). Texts are not
    looked at here, so their length does not matter.
    """
    base = [c for c in df.columns if c not in ("source_size", "target", "copies", "taken")]
    rows = df.select(
        F.struct(*[by_name(c).alias(c) for c in base]).alias("row"), by_name(source_col).cast("string").alias("source"),
        F.coalesce(by_name(size_col).cast("long"), F.lit(0)).alias("size"), F.xxhash64(F.lit(seed), by_name(id_col)).alias("tie"),
    )
    rows = written(rows, "sized")
    known = written(targets(ranked_sources(rows), weights, most), "targets")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null is a source of its own
    known = known.select(key.alias("sk"), "source_size", "target", F.ceil(F.col("n_rows") / BLOCK).alias("n_blocks"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = (
        rows.withColumn("sk", key).join(known, "sk").withColumn("whole", F.floor(ratio).cast("int")).withColumn("p", ratio - F.col("whole"))
        .withColumn("block", F.pmod(F.xxhash64("tie", F.lit(1)), "n_blocks"))
    )
    settled = written(pivot(planned, ["sk", "block"], seed), "settled")
    left = settled.where("open").select("sk", "block", "p", "size", "tie", F.col("block").alias("node"))
    blocks = known.agg(F.max("n_blocks")).first()[0] or 1
    decided = []
    while blocks > 1:
        left = left.drop("extra", "open").withColumn("node", F.floor(F.col("node") / FAN_IN))
        step = written(pivot(left, ["sk", "node"], seed + 1), "residuals")
        decided.append(step.where("not open").select("sk", "block", F.col("extra").alias("drawn")))
        left, blocks = step.where("open").select("sk", "block", "p", "size", "tie", "node"), -(-blocks // FAN_IN)
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), "sk", "tie"), F.lit(1 << 30)) / float(1 << 30)
    last = left.select("sk", "block", (draw < F.col("p")).cast("int").alias("drawn"))
    for d in decided:
        last = last.unionByName(d)
    opened = settled.where("open").join(last, ["sk", "block"]).withColumn("extra", F.col("drawn")).drop("drawn")
    out = settled.where("not open").unionByName(opened).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in base], "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def with_size(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("size", F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(with_size(docs).drop("text")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
