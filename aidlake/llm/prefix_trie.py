"""The trie of conversations' common beginnings, built as a Patricia tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.scan import numbered, segmented
from .common import by_name, drop, shards, written

#: Turns of a block: longer conversations are cut, so that no task holds one whole.
BLOCK = 256
#: Characters of a turn's digest, of which a block is the sequence.
WIDE = 32
#: Characters of ids that are hashed in one piece.
PIECE = 1 << 20
ROOT = hashlib.md5(b"r,0,0,0").hexdigest()
NONE = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, segment, i, key, words): each turn's number in its conversation, digest and words; texts travel no further."""
    text, role = (F.coalesce(by_name(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    rows = df.where(by_name(conv_col).isNotNull()).select(by_name(conv_col).cast("long").alias("conv"), by_name(turn_col).alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["turn", "role", "digest"]
    rows = segmented(rows, ["conv"], order)
    key = F.md5(F.concat("digest", "role").cast("binary")).alias("key")
    return written(numbered(rows, ["conv"], order, "i").select("conv", "segment", "i", key, "words"), "turns")


def as_they_are(t: DataFrame) -> DataFrame:
    """(conv, d, key, words, total) of conversations as they stand, d from 1; a turnless one has d null."""
    sizes = t.groupBy("conv", "segment").agg(F.count("*").alias("size"))
    total = sizes.join(sizes.groupBy("conv").agg(F.sum("size").alias("total")), "conv").drop("size")
    return t.join(total, ["conv", "segment"]).select("conv", F.col("i").cast("long").alias("d"), "key", "words", "total")


def rebuilt(t: DataFrame) -> DataFrame:
    """as_they_are() of conversations that begin with the first h turns of conversation c - c % 20, h = crc32(c) % 4."""
    pieces = t.groupBy("conv", "segment").agg(F.count("*").alias("size"))
    sizes = written(pieces.groupBy("conv").agg(F.sum("size").alias("size")), "sizes")
    plan = sizes.withColumn("base", F.col("conv") - F.col("conv") % 20).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 4)
    base = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    plan = plan.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_size", F.lit(0))))
    plan = written(plan.select("conv", "base", "h", "m", (F.col("m") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("total")), "plan")
    # A conversation's rows are met segment by segment, so that a very long one is in many tasks.
    own = t.join(plan.join(pieces.select("conv", "segment"), "conv"), ["conv", "segment"]).where("i > h").select("conv", (F.col("m") + F.col("i") - F.col("h")).alias("d"), "key", "words", "total")
    first = t.where("conv % 20 = 0 and i <= 3").select(F.col("conv").alias("base"), F.col("i").cast("long").alias("d"), "key", "words")
    begun = plan.join(first, "base").where("d <= h").select("conv", "d", "key", "words", "total")
    bare = plan.where("total = 0").select("conv", F.lit(None).cast("long").alias("d"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("words"), "total")
    return own.unionByName(begun).unionByName(bare)


def blocks(rows: DataFrame) -> DataFrame:
    """(conv, b, root, next, seq, words, last): blocks of BLOCK turns; root and next name the paths before and after one."""
    b = F.coalesce(F.floor((F.col("d") - 1) / BLOCK), F.lit(0)).cast("long").alias("b")
    held = F.sort_array(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "key", "words"))))
    cut = rows.groupBy("conv", b).agg(held.alias("of"), F.max("total").alias("total"))
    cut = cut.select("conv", "b", F.array_join(F.transform("of", lambda x: x["key"]), "").alias("seq"), F.transform("of", lambda x: x["words"]).alias("words"), (F.col("total") <= (F.col("b") + 1) * BLOCK).alias("last"))
    path = Window.partitionBy("conv").orderBy("b")
    name = lambda b, *sums: F.md5(F.concat_ws(",", F.lit("r"), b.cast("string"), *[s.cast("string") for s in sums]).cast("binary"))
    own = [F.xxhash64(F.lit(i), "b", "seq").cast("decimal(38,0)") for i in (1, 2)]
    upto = [F.sum(h).over(path.rowsBetween(Window.unboundedPreceding, 0)) for h in own]
    cut = cut.select("*", *[h.alias(f"own{i}") for i, h in enumerate(own)], *[s.alias(f"sum{i}") for i, s in enumerate(upto)])
    before = [F.col(f"sum{i}") - F.col(f"own{i}") for i in (0, 1)]
    return cut.select("conv", "b", name(F.col("b"), *before).alias("root"), name(F.col("b") + 1, F.col("sum0"), F.col("sum1")).alias("next"), "seq", "words", "last")


def named(k: Column) -> Column:
    """The name of the path to the k-th turn of a row(root, next, seq)."""
    inner = F.md5(F.concat(F.col("root"), F.substring(F.col("seq"), F.lit(1), (k * WIDE).cast("int"))).cast("binary"))
    return F.when(k == 0, F.col("root")).when(k == BLOCK, F.col("next")).otherwise(inner)


def common(a: str, b: str) -> int:
    """Turns that two sequences have in common at their beginning."""
    lo, hi = 0, min(len(a), len(b)) // WIDE
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * WIDE] == b[: mid * WIDE] else (lo, mid - 1)
    return lo


def ordered(distinct: DataFrame) -> DataFrame:
    """distinct(root, seq, ...) in the order of sequences, with sid and lcp, the turns shared with the sequence before."""
    more = T.StructType([*distinct.schema, T.StructField("part", T.IntegerType()), T.StructField("sid", T.LongType()), T.StructField("lcp", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            lcp = []
            for r, s in zip(b.column("root").to_pylist(), b.column("seq").to_pylist(), strict=True):
                lcp.append(-1 if last is None else common(last[1], s) if last[0] == r else 0)
                last = r, s
            sid = pa.array([(part << 40) + n + i for i in range(len(lcp))], pa.int64())
            n += len(lcp)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(lcp), pa.int32()), sid, pa.array(lcp, pa.int32())], [*b.schema.names, "part", "sid", "lcp"])

    rows = written(distinct.repartitionByRange(shards(distinct.sparkSession), "root", "seq").sortWithinPartitions("root", "seq").mapInArrow(work, more), "sequences")
    # The first sequence of a range shares its beginning with the last one of the range before: a row a range.
    ends = rows.groupBy("part").agg(F.min(F.struct("root", "seq")).alias("first"), F.max(F.struct("root", "seq")).alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(Window.orderBy("part"))).where("before.root = first.root")
    turns = (F.least(F.length("before.seq"), F.length("first.seq")) / WIDE).cast("int")
    same = lambda k: F.substring("before.seq", F.lit(1), k * WIDE) == F.substring("first.seq", F.lit(1), k * WIDE)
    shared = F.when(turns > 0, F.size(F.filter(F.sequence(F.lit(1), turns), same))).otherwise(0)
    ends = ends.select(F.col("part").alias("of"), shared.alias("border"))
    lcp = F.when(F.col("lcp") < 0, F.coalesce("border", F.lit(0))).otherwise(F.col("lcp")).alias("lcp")
    return rows.join(F.broadcast(ends), F.col("part") == F.col("of"), "left").select(*distinct.columns, "sid", lcp)


def compressed(rows: DataFrame) -> DataFrame:
    """(name, parent, top, words, n_end, c_end): the points of the Patricia tree with the edge to each from its parent.

    Points are the root, the ends of conversations (leaves among them) and of full blocks, and where two neighbours in the
    order of sequences part. In that order a sequence is the first to have its turns past lcp, and its path to there ends
    in a point; so each edge is made once, from one sequence. top is the depth of the parent, words has the edge's turns.
    """
    m = (F.length("seq") / WIDE).cast("int")
    marks = rows.where("lcp > 0").select(named(F.col("lcp")).alias("name")).distinct()
    new = rows.where(m > F.col("lcp"))
    nodes = new.withColumn("k", F.explode(F.sequence(F.col("lcp") + 1, m))).select("sid", "k", named(F.col("k")).alias("name"))
    cuts = nodes.join(marks, "name", "left_semi").groupBy("sid").agg(F.collect_list("k").alias("cuts"))
    stops = F.array_sort(F.array_distinct(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array(m))))
    edges = new.join(cuts, "sid", "left").withColumn("stops", stops).select("*", F.posexplode("stops").alias("at", "hi"))
    edges = edges.withColumn("lo", F.when(F.col("at") == 0, F.col("lcp")).otherwise(F.element_at("stops", F.greatest("at", F.lit(1)))))
    end = F.col("hi") == m
    edges = edges.select(
        named(F.col("hi")).alias("name"), named(F.col("lo")).alias("parent"), (F.col("b") * BLOCK + F.col("lo")).alias("top"), F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("words"),
        F.when(end, F.col("n_end")).otherwise(0).alias("n_end"), F.when(end, F.col("c_end")).alias("c_end"),
    )
    root = rows.where(F.col("root") == ROOT).groupBy("root").agg(F.sum(F.when(m == 0, F.col("n_end")).otherwise(0)).alias("n_end"), F.min(F.when(m == 0, F.col("c_end"))).alias("c_end"))
    root = root.select(F.col("root").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(-1).cast("long").alias("top"), F.array(F.lit(0).cast("long")).alias("words"), "n_end", "c_end")
    return written(edges.unionByName(root), "edges")


def ancestors(edges: DataFrame) -> list[DataFrame]:
    """(name, jump) tables: the parent of each point, then the ancestor 2, 4, 8, ... points above, where there is one."""
    out = [written(edges.where("parent is not null").select("name", F.col("parent").alias("jump")), "jumps")]
    while True:
        j = out[-1]
        above = j.select(F.col("name").alias("jump"), F.col("jump").alias("above"))
        j = written(j.where(F.col("jump") != ROOT).join(above, "jump").select("name", F.col("above").alias("jump")), "jumps")
        if j.isEmpty():
            return out
        out.append(j)


def subtree(values: DataFrame, jumps: list[DataFrame], aggs: dict[str, str]) -> DataFrame:
    """values(name, ...) aggregated (sum or min) over each point's subtree, in as many rounds as a path's length has binary digits.

    After round i a point has what is less than 2 ** i points below; the points exactly that far below add theirs.
    """
    how = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least}
    for j in jumps:
        more = values.join(j, "name").groupBy("jump").agg(*[getattr(F, f)(c).alias(f"_{c}") for c, f in aggs.items()]).withColumnRenamed("jump", "name")
        new = written(values.join(more, "name", "left").select("name", *[how[f](F.col(c), F.col(f"_{c}")).alias(c) for c, f in aggs.items()]), "subtrees")
        if j is not jumps[0]:
            drop(values)
        values = new
    return values


def ends(ids: DataFrame) -> DataFrame:
    """(name, ends_sha256): SHA-256 of each name's conv ids, in order and joined by commas.

    Ids are sorted and written out in ranges, so the one task that a hash of many ids needs reads only text, piece by piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, name, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        out: list[tuple] = []
        for b in batches:
            for who, c in zip(b.column("name").to_pylist(), b.column("conv").to_pylist(), strict=True):
                if held and (who != name or size > PIECE):
                    out.append((name, part, n, ",".join(held)))
                    n, held, size = n + 1, [], 0
                name = who
                held.append(str(c))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["name", "part", "n", "ids"])
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, part, n, ",".join(held))], ["name", "part", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha = None, None
        for b in batches:
            done = []
            for who, ids in zip(b.column("name").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if who != name:
                    if sha:
                        done.append((name, sha.hexdigest()))
                    name, sha = who, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["name", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sha.hexdigest()])], ["name", "ends_sha256"])

    cut = ids.repartitionByRange(shards(ids.sparkSession), "name", "conv").sortWithinPartitions("name", "conv").mapInArrow(pieces, "name string, part long, n long, ids string")
    return cut.repartition("name").sortWithinPartitions("name", "part", "n").mapInArrow(hashed, "name string, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of rows(conv, d, key, words, total); see prefix_trie()."""
    cut = written(blocks(rows), "blocks")
    last = F.when(F.col("last"), F.col("conv"))
    distinct = cut.groupBy("root", "seq").agg(F.first("next").alias("next"), F.first("b").alias("b"), F.first("words").alias("words"), F.count(last).alias("n_end"), F.min(last).alias("c_end"))
    edges = compressed(written(ordered(distinct), "ordered"))
    jumps = ancestors(edges)
    children = edges.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("children"))
    leaf = edges.join(children, "name", "left").select("name", "n_end", "c_end", F.coalesce("children", F.lit(0)).alias("children"))
    leaf = written(leaf, "children")
    below = subtree(leaf.select("name", F.col("n_end").alias("n"), F.col("c_end").alias("conv"), F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("leaves")), jumps, {"n": "sum", "conv": "min", "leaves": "sum"})
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, w: s + w)
    saved = edges.join(below, "name").select("name", ((F.col("n") - 1) * total(F.col("words"))).alias("saved"))
    saved = subtree(written(saved, "saved"), jumps, {"saved": "sum"}).withColumnRenamed("saved", "saved_below")
    above = below.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
    hashes = ends(cut.where("last").select(named((F.length("seq") / WIDE).cast("int")).alias("name"), "conv"))
    points = edges.join(below, "name").join(saved, "name").join(leaf.select("name", "children"), "name").join(hashes, "name", "left")
    points = written(points, "points").join(above, "parent", "left")
    nodes = points.select("*", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("i"))
    is_point = F.col("i") == F.size("words")
    edge = lambda start: (F.col("n") - 1) * total(F.slice("words", start, F.size("words")))
    return nodes.select(
        F.col("conv").alias("conv_id"), (F.col("top") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 1, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(is_point, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved_below") - edge(F.lit(1)) + edge(F.col("i"))).alias("saved_tokens"), F.when(is_point, F.coalesce("ends_sha256", F.lit(NONE))).otherwise(NONE).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", again: bool = False) -> DataFrame:
    """A row for each distinct beginning of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Sequences of turns are sorted; where neighbours part, and where conversations end, are the points of a Patricia tree.
    Sums over subtrees are taken on its points, and the nodes between two points follow from their edge. again: first
    rebuilds the conversations as rebuilt() says. n_convs counts the conversations that begin so, conv_id is the smallest
    of them, parent_conv_id the parent's; n_leaves and saved_tokens go over the subtree, itself included; a node saves the
    words of its last turn for all its conversations but one. ends_sha256 has the ids of those that end there.

    Turns are ordered by turn (nulls first), ties by role and then by the text's MD5; repeated rows are turns of their own.
    Null roles and texts are empty. Rows with a null conv_id belong to no conversation and are left out. An empty table has
    no nodes. Long texts travel as digests; long conversations are cut into blocks, so none is in one task. Other columns
    are ignored, whatever their names. Equal turns are told by MD5.
    """
    t = turns(df, conv_col, turn_col, role_col, text_col)
    return trie(rebuilt(t) if again else as_they_are(t))


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), again=True)


#: CRC-32 of a decimal id, bit by bit, as this SQL has no such function.
CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

#: The plain trie: every beginning of every conversation.
SQL = rf"""
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i, md5(md5(coalesce(text, '')) || coalesce(role, '')) AS k,
               len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM conversations WHERE conv_id IS NOT NULL),
    v AS (SELECT c, c - c % 20 AS b, ({CRC}) % 4 AS h FROM (SELECT DISTINCT c FROM t) x),
    l AS (SELECT v.c, v.b, v.h, least(v.h, count(t.i)) AS m FROM v LEFT JOIN t ON t.c = v.b GROUP BY v.c, v.b, v.h),
    r AS (SELECT l.c, t.i AS d, t.k, t.w FROM l JOIN t ON t.c = l.b AND t.i <= l.h UNION ALL SELECT l.c, l.m + t.i - l.h, t.k, t.w FROM l JOIN t ON t.c = l.c AND t.i > l.h),
    p AS (SELECT c, d, w, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM l),
    e AS (SELECT c, max(d) AS d FROM p GROUP BY c),
    n AS (SELECT p.k, p.d, any_value(p.w) AS w, min(p.c) AS conv, count(*) AS n, string_agg(CASE WHEN e.d = p.d THEN p.c::VARCHAR END, ',' ORDER BY p.c) AS ends FROM p JOIN e ON e.c = p.c GROUP BY p.k, p.d),
    ch AS (SELECT left(k, len(k) - 32) AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
    f AS (SELECT n.*, coalesce(ch.n, 0) AS children FROM n LEFT JOIN ch ON ch.k = n.k),
    s AS (SELECT left(f.k, 32 * a) AS k, sum((f.children = 0)::INT)::BIGINT AS leaves, sum((f.n - 1) * f.w)::BIGINT AS saved FROM f, unnest(range(f.d + 1)) AS u(a) GROUP BY 1)
    SELECT f.conv AS conv_id, f.d::BIGINT AS depth, u.conv AS parent_conv_id, f.n AS n_convs, f.children::BIGINT AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
    FROM f JOIN s ON s.k = f.k LEFT JOIN f u ON f.d > 0 AND u.k = left(f.k, len(f.k) - 32)"""
