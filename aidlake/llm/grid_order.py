"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import by_name, components, spanning, written

#: Leading principal dimensions of the grid, vectors that they are fitted on, vectors of a block, children of an interval.
DIMS, FITTED, BLOCK, FAN_OUT_BITS = 16, 4_096, 64, 4
#: Boxes that a block's rows are parted into at most, for a finer look before blocks meet.
PARTS = 8
#: Blocks of a super-block are 2 ** this: a task gets two super-blocks' blocks once for all pairs among them.
SUPER_BITS = 4


def usable(df: DataFrame) -> DataFrame:
    """df(id, label, vec as array of double) with key: a digest of label and vector, null if it links with nothing."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    text = F.array_join(F.transform("vec", lambda x: F.hex(F.xxhash64(x)).cast("string")), "")
    return df.withColumn("key", F.when(ok, F.sha2(F.concat_ws("|", F.hex(F.col("label").cast("string")), F.size("vec"), text), 256)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two, so that no square overflows or vanishes; their directions stay exactly as they are."""
    _, power = np.frexp(np.abs(x).max(axis=-1, keepdims=True))
    return np.ldexp(x, -power)


def principal(classes: DataFrame) -> np.ndarray:
    """Leading principal dimensions (columns) of a bounded sample of unit vectors, zero-padded to the longest.

    The sample only turns the grid: any orthonormal columns give the same links. Where lengths differ, shorter
    vectors are padded with zeros; they are compared with vectors of their own length alone.
    """
    rows = classes.orderBy(F.xxhash64("key"), "key").limit(FITTED).select("vec").collect()
    longest = classes.agg(F.max(F.size("vec"))).first()[0] or 1
    x = np.zeros((max(1, len(rows)), longest))
    for i, r in enumerate(rows):
        v = scaled(np.asarray(r["vec"], np.float64))
        x[i, : len(v)] = v / np.linalg.norm(v)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return np.ascontiguousarray(vt[: min(DIMS, len(vt))].T)


def projected(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes, and the length of what is left: none of it brings two vectors further apart."""
    at = unit @ axes
    rest = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", unit, unit) - np.einsum("ij,ij->i", at, at)))
    return np.column_stack([at, rest])


def stretches(at: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Rows from which to which stay together: at most PARTS stretches, cut at the largest jumps beyond eps."""
    jump = np.sqrt((np.diff(at, axis=0) ** 2).sum(1))
    cuts = np.argsort(-jump, kind="stable")[: PARTS - 1]
    edges = [0, *(np.sort(cuts[jump[cuts] > eps]) + 1).tolist(), len(at)]
    return list(zip(edges, edges[1:], strict=False))


def apart(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """The squared distance of two boxes."""
    sides = F.zip_with(F.zip_with(b_lo, a_hi, lambda x, y: x - y), F.zip_with(a_lo, b_hi, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(sides, F.lit(0.0), lambda total, x: total + x * x)


def blocks(classes: DataFrame, axes: np.ndarray, eps: float, parts: int, kind: str = "f8") -> DataFrame:
    """Classes in epsilon grid order, cut into blocks of BLOCK rows of one label and length, with bounding boxes.

    The boxes are lists lo and hi over the axes and what is left beside them; parts are boxes about stretches of the
    block's rows, cut where they jump. kind is the type that holds the vectors' numbers without loss: f4 for floats.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.asarray(v, np.float64) for v in b.column("vec").to_pylist()]
            unit = np.zeros((len(packed), len(axes)))
            for i, v in enumerate(packed):
                v = scaled(v)
                unit[i, : len(v)] = v / np.linalg.norm(v)
            at = projected(unit, axes)
            cells = np.floor(at[:, :-1] / eps).astype(np.int32)
            columns = {
                "class": b.column("class"), "label": b.column("label"), "size": pa.array([len(v) for v in packed], pa.int32()), "n": b.column("n"),
                "cell": pa.array(cells.tolist(), pa.list_(pa.int32())), "at": pa.array(at.tolist(), pa.list_(pa.float64())),
                "vec": pa.array([v.astype(kind).tobytes() for v in packed], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    label, field = classes.schema["label"].dataType, T.StructField
    schema = T.StructType(
        [
            field("class", T.LongType()), field("label", label), field("size", T.IntegerType()), field("n", T.LongType()),
            field("cell", T.ArrayType(T.IntegerType())), field("at", T.ArrayType(T.DoubleType())), field("vec", T.BinaryType()),
        ]
    )
    placed = classes.select("class", "label", "n", "vec").mapInArrow(place, schema)
    ordered = placed.repartitionByRange(parts, "label", "size", "cell", "class").sortWithinPartitions("label", "size", "cell", "class")
    binary, box = T.BinaryType(), T.ArrayType(T.DoubleType())
    boxes = T.ArrayType(T.StructType([field("lo", box), field("hi", box)]))
    out = T.StructType([field("block", T.LongType()), field("label", label), field("size", T.IntegerType()), *[field(c, binary) for c in ("classes", "counts", "vecs")], field("lo", box), field("hi", box), field("parts", boxes)])
    arrow = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, group = TaskContext.get().partitionId() << 32, [], None

        def made() -> pa.RecordBatch:
            nonlocal number
            at = np.array([r["at"] for r in held])
            row = {
                "block": number, "label": held[0]["label"], "size": held[0]["size"], "classes": np.array([r["class"] for r in held], np.int64).tobytes(),
                "counts": np.array([r["n"] for r in held], np.int64).tobytes(), "vecs": b"".join(r["vec"] for r in held), "lo": at.min(0).tolist(), "hi": at.max(0).tolist(),
                "parts": [{"lo": at[x:y].min(0).tolist(), "hi": at[x:y].max(0).tolist()} for x, y in stretches(at, eps)],
            }
            number += 1
            return pa.RecordBatch.from_pylist([row], arrow)

        for b in batches:
            for r in b.to_pylist():
                if held and (group != (r["label"], r["size"]) or len(held) >= BLOCK):
                    yield made()
                    held = []
                group = (r["label"], r["size"])
                held.append(r)
        if held:
            yield made()

    return ordered.mapInArrow(cut, out)


def near_blocks(boxes: DataFrame, m: int, eps: float) -> DataFrame:
    """(a, b): pairs of blocks of a label, a <= b, whose boxes (m numbers each in lo and hi) are within eps of each other.

    The recursion on intervals of the sequence: an interval is the blocks that share leading bits of their number,
    with the box about them. A pair of intervals that is provably distant is skipped; any other is replaced by the
    pairs of its children, until intervals are single blocks. All pairs of a level are taken in one join.
    boxes: (block, label, size, lo, hi, parts).
    """
    part, seq = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    parts, most = (int(x or 0) for x in boxes.agg(F.max(part), F.max(seq)).first())
    bits = most.bit_length()  # the numbers without their gaps: fewer levels
    boxes = boxes.withColumn("block", F.shiftleft(part, bits).bitwiseOR(seq))
    levels = math.ceil(max(1, parts.bit_length() + bits) / FAN_OUT_BITS)
    by = ["label", "size"]

    def nodes(level: int, name: str) -> DataFrame:
        ends = [f(F.col(c)[j]).alias(f"{c}{j}") for f, c in ((F.min, "lo"), (F.max, "hi")) for j in range(m)]
        up = boxes.withColumn("node", F.shiftright("block", level * FAN_OUT_BITS)).groupBy(*by, "node").agg(*ends)
        box = [F.array(*[f"{c}{j}" for j in range(m)]).alias(f"{name}_{c}") for c in ("lo", "hi")]
        return up.select(*by, F.col("node").alias(name), F.shiftright("node", FAN_OUT_BITS).alias(f"{name}_up"), *box)

    bound = eps * eps * (1 + 1e-9) + 1e-12
    near = apart(*[F.col(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi")]) <= bound
    pairs = boxes.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("a_up"), F.lit(0).cast("long").alias("b_up"))
    for level in range(levels - 1, -1, -1):
        met = pairs.join(nodes(level, "a"), [*by, "a_up"]).join(nodes(level, "b"), [*by, "b_up"]).where((F.col("a") <= F.col("b")) & near)
        pairs = met.select(*by, F.col("a").alias("a_up"), F.col("b").alias("b_up"))
    name = lambda c: F.shiftleft(F.shiftright(c, bits), 32).bitwiseOR(F.col(c).bitwiseAND(F.lit((1 << bits) - 1)))
    # A finer look at last: a pair stays if some stretch of one block is near some stretch of the other.
    side = lambda s: boxes.select(F.col("block").alias(f"{s}_up"), F.col("parts").alias(f"{s}_parts"))
    met = pairs.join(side("a"), "a_up").join(side("b"), "b_up")
    met = met.where(F.exists("a_parts", lambda x: F.exists("b_parts", lambda y: apart(x["lo"], x["hi"], y["lo"], y["hi"]) <= bound)))
    return met.select(name("a_up").alias("a"), name("b_up").alias("b"))


def links(cut: DataFrame, pairs: DataFrame, threshold: float, kind: str = "f8") -> DataFrame:
    """(class, root, n): for the pairs of blocks of two super-blocks, how many vectors a class links to, and its group among them.

    A pair of super-blocks is one task's group of 2 * 2 ** SUPER_BITS blocks at most: first the pairs that are to be
    compared, then each block once.
    """
    high = lambda c: F.shiftright(c, SUPER_BITS)
    todo = pairs.select(high("a").alias("sa"), high("b").alias("sb"), "a", "b")
    needed = todo.select("sa", "sb", F.explode(F.array("a", "b")).alias("a")).distinct()
    sent = needed.join(cut.select(F.col("block").alias("a"), "classes", "counts", "vecs"), "a").select("sa", "sb", "a", F.lit(None).cast("long").alias("b"), "classes", "counts", "vecs")
    none = [F.lit(None).cast("binary").alias(c) for c in ("classes", "counts", "vecs")]
    rows = todo.select("sa", "sb", "a", "b", *none).unionByName(sent)
    rows = rows.repartition("sa", "sb").sortWithinPartitions("sa", "sb", F.col("b").isNull(), "a", "b")

    def compared(ask: list[tuple[int, int]], held: dict[int, tuple]) -> pa.RecordBatch | None:
        u, v, who, many = [], [], [], []
        for a, b in ask:
            (ca, na, va, ra), (cb, nb, vb, rb) = held[a], held[b]
            near = (va @ vb.T) / ra[:, None] / rb >= threshold
            if a == b:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            x, y = np.nonzero(near)
            node, root = spanning(ca[x], cb[y])
            u.append(node)
            v.append(root)
            who.append(ca)
            many.append(near @ nb)
            if a != b:
                who.append(cb)
                many.append(near.T @ na)
        if not u:
            return None
        node, root = spanning(np.concatenate(u), np.concatenate(v))
        classes, at = np.unique(np.concatenate(who), return_inverse=True)
        n = np.zeros(len(classes), np.int64)
        np.add.at(n, at, np.concatenate(many))
        roots = classes.copy()
        roots[np.searchsorted(classes, node)] = root
        return pa.RecordBatch.from_arrays([pa.array(x[n > 0]) for x in (classes, roots, n)], ["class", "root", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ask, held = None, [], {}
        for batch in batches:
            for r in batch.to_pylist():
                if (r["sa"], r["sb"]) != group:
                    if group and (found := compared(ask, held)):
                        yield found
                    group, ask, held = (r["sa"], r["sb"]), [], {}
                if r["b"] is not None:
                    ask.append((r["a"], r["b"]))
                    continue
                c, n = (np.frombuffer(r[x], np.int64) for x in ("classes", "counts"))
                v = np.frombuffer(r["vecs"], kind).reshape(len(c), -1).astype(np.float64)
                v = v if kind == "f4" else scaled(v)
                held[r["a"]] = (c, n, v, np.sqrt(np.einsum("ij,ij->i", v, v)))
        if group and (found := compared(ask, held)):
            yield found

    return rows.mapInArrow(work, "class long, root long, n long")


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, trace: list | None = None) -> DataFrame:
    """(id, n_links, component_id, kept): vectors of equal label linked where their cosine reaches the threshold.

    Unit vectors with cosine >= t are within eps = sqrt(2 - 2t); a projection on orthonormal dimensions brings
    points no further apart. So in the order of grid cells of width eps on the leading principal dimensions, blocks
    whose boxes are further apart than eps have no link, whole intervals of blocks likewise, and what is left is
    compared exactly, in double precision. Equal vectors are one class with a count; blocks travel by super-blocks,
    whose pairs give a count a class and a spanning forest of their links, never the pairs. trace, if given, gets
    (blocks, pairs of blocks that met).

    Null, zero and non-finite vectors, vectors with null components and null labels link with nothing: n_links 0,
    a group of their own. Vectors of different lengths do not link. Repeated rows are vectors of their own that
    link with each other; null ids do not become a group's id unless it has no other. An empty table gives none.
    Very long vectors make large blocks, but no other trouble; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(usable(df.select(by_name(id_col).alias("id"), by_name(label_col).alias("label"), by_name(vec_col).cast("array<double>").alias("vec"))), "vectors")
    good = rows.where("key is not null")
    classes = written(good.groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("least")).withColumn("class", F.monotonically_increasing_id()), "classes")
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9)
    axes = principal(classes)
    kind = "f4" if df.schema[vec_col].dataType == T.ArrayType(T.FloatType()) else "f8"
    cut = written(blocks(classes, axes, eps, parts, kind), "blocks")
    pairs = written(near_blocks(cut.drop("classes", "counts", "vecs"), axes.shape[1] + 1, eps), "block-pairs")
    if trace is not None:
        trace.append((cut.count(), pairs.count()))
    found = written(links(cut, pairs, threshold, kind), "links")
    roots = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("class").agg(F.sum("n").alias("others"))
    grouped = classes.select("class", "key", "n", "least").join(roots.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left").withColumn("root", F.coalesce("root", "class"))
    grouped = written(grouped, "grouped")
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    known = grouped.join(ids, "root").select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
