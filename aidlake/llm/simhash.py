"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, by_name, components, drop, mixed, spanning, window_hashes, written

#: Table rows of one key beyond which a key is split into a grid of tasks.
HOT_ROWS = 16_384
#: A comparison of two fingerprints in terms of a probe that is made, moved and sorted.
MATCH_COST = 0.02
#: Candidate pairs looked at in one go.
PAIRS = 2_000_000
#: MinHash values of a band and bands: of pairs with Jaccard 0.8, all but (1 - 0.8 ** 4) ** 20 = 0.003 % share a band.
BAND, BANDS = 4, 20
#: Pivots that a bucket's nodes meet in each round of stars, and bits that turn the order of nodes round, for each pivot.
PIVOTS = (1, 6)
TURNS = [int(x) for x in np.random.default_rng(7).integers(1, 2**62, max(PIVOTS))]
#: Hashes of a block that meets others in a task, and columns of a block's matrix made at once.
BLOCK_HASHES, COLUMNS = 1 << 17, 1 << 14


def fingerprint(text: bytes | None, k: int) -> int:
    """64 bits, each 1 if set in over half of the XXH64 (seed 42) of the k-word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, at = b" ".join(words), [0, *accumulate(len(w) + 1 for w in words)]
    k = min(k, len(words))
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):
        h = np.array([xxhash.xxh64_intdigest(joined[at[i] : at[i + k] - 1], 42) for i in range(lo, min(n, lo + 65_536))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """df without the text, and fp: the fingerprint as a signed long."""
    kept = [f for f in df.schema if f.name != text_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            fp = np.array([fingerprint(t, k) for t in b.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            others = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in others), pa.array(fp)], [*(b.schema.names[i] for i in others), "fp"])

    schema = type(df.schema)([*kept]).add("fp", "long")
    return df.withColumn(text_col, F.col(text_col).cast("binary")).mapInArrow(work, schema)


def segments(n: int, distance: int) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of each segment for n fingerprints.

    With the radii's sum at distance + 1 - number of segments, two fingerprints within the distance are within the
    radius in a segment at least: otherwise they would differ in sum(radius + 1) = distance + 1 bits. So the result
    is the same for every number of segments; the one is taken that costs least: a probe travels, a table match is
    a comparison. More segments mean smaller balls but longer lists, so their number falls as n grows.
    """
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, max(1, distance) + 1):
        spare, more = divmod(distance + 1 - m, m)
        width, wide = divmod(64, m)
        parts, low, cost = [], 0, 0.0
        for i in range(m):
            bits, radius = width + (i >= m - wide), spare + (i < more)
            parts.append((low, bits, radius))
            ball = sum(comb(bits, r) for r in range(radius + 1))
            cost += ball * (1 + MATCH_COST * n / 2**bits)
            low += bits
        if max(p[1] for p in parts) <= 32 and cost < best[0]:
            best = cost, parts
    return best[1] or [(0, 32, distance // 2), (32, 32, distance // 2)]


def ball(own: Column, low: int, bits: int, radius: int) -> Column:
    """The keys of the Hamming ball about a segment's key, as an array of structs (seg, key, d); d = 0 is the own key."""
    masks = [(0, 0)] + [(sum(1 << b for b in c), d) for d in range(1, radius + 1) for c in combinations(range(bits), d)]
    array = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(d).alias("d")) for m, d in masks])
    return F.transform(array, lambda x: F.struct(F.lit(low).alias("seg"), own.bitwiseXOR(x["m"]).alias("key"), x["d"].alias("d")))


def probes(fp: Column, low: int, bits: int, radius: int) -> Column:
    """ball() about the fingerprint's segment."""
    return ball(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")), low, bits, radius)


def hot_keys(rows: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(seg, key, ni, nj): into how many shares the table rows and the probes of hot keys, and of keys near them, are cut.

    A key's probes come from the keys in its ball, so those of a hot key's neighbours are counted from the hot keys,
    which are few, without counting all probes.
    """
    many = written(rows.where("d = 0").groupBy("seg", "key").count().where(F.col("count") > HOT_ROWS), "hot-keys")
    near = None
    for low, bits, radius in parts:
        one = many.where(F.col("seg") == low).select("count", F.explode(ball(F.col("key"), low, bits, radius)).alias("x")).select("x.seg", "x.key", "count")
        near = one if near is None else near.unionByName(one)
    asked = near.groupBy("seg", "key").agg(F.sum("count").alias("asked"))
    share = lambda c: F.coalesce(F.ceil(F.col(c) / HOT_ROWS), F.lit(1)).cast("int")
    return asked.join(many, ["seg", "key"], "left").select("seg", "key", share("count").alias("ni"), share("asked").alias("nj"))


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(u, v): links that join the same fingerprints (distinct, column fp) as all pairs within the distance."""
    parts = segments(fps.count(), distance)
    rows = fps.select("fp", F.explode(F.concat(*[probes(F.col("fp"), *p) for p in parts])).alias("x")).select("x.seg", "x.key", "x.d", "fp")
    # Written first: a small table of hot keys is then joined without moving the rows, a large one with a shuffle.
    hot = written(hot_keys(rows, parts), "hot-shares")
    own = lambda n: F.pmod(F.xxhash64("fp"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    rows = rows.join(hot, ["seg", "key"], "left")
    # A hot key's table rows and probes meet in a grid of tasks; each pair meets once.
    table = rows.where("d = 0").select("seg", "key", "fp", F.lit(0).alias("probe"), own("ni").alias("i"), every("nj").alias("j"))
    asked = rows.select("seg", "key", "fp", F.lit(1).alias("probe"), every("ni").alias("i"), own("nj").alias("j"))
    met = table.unionByName(asked).repartition("seg", "key", "i", "j").sortWithinPartitions("seg", "key", "i", "j", "probe")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for b in batches:
            seg, key, i, j, probe = (b.column(n).to_numpy() for n in ("seg", "key", "i", "j", "probe"))
            fp = b.column("fp").to_numpy().view(np.uint64)
            if not len(fp):
                continue
            new = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            # Table rows come first in each group; those of a group that began in an earlier batch are held.
            first = (seg[0], key[0], i[0], j[0])
            carried = held if first == last else held[:0]
            pool = np.concatenate([carried, fp])
            offset, start = len(carried), np.repeat(new, np.diff(np.append(new, len(fp))))
            n_table = np.add.reduceat((probe == 0).astype(np.int64), new)
            lo = new + offset
            lo[0] -= offset
            n_table[0] += offset
            group = np.searchsorted(new, start, side="right") - 1
            asks = np.flatnonzero((probe == 1) & (n_table[group] > 0))
            if offset:  # a held table is followed by this batch's own table rows of the same group, then by probes
                pool = np.concatenate([carried, fp])
            many = n_table[group[asks]]
            ends = np.cumsum(many)
            at = 0
            while at < len(asks):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
                part, cnt = asks[at:to], many[at:to]
                mine = np.repeat(fp[part], cnt)
                idx = np.repeat(lo[group[part]], cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                other = pool[idx]
                near = (np.bitwise_count(mine ^ other) <= distance) & (mine > other)
                if near.any():
                    found.append((mine[near], other[near]))
                at = to
            end = int(new[-1])
            tail = fp[end:][probe[end:] == 0]
            held = np.concatenate([carried, tail]) if len(new) == 1 else tail
            last = (seg[-1], key[-1], i[-1], j[-1])
            if found:
                u, v = spanning(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return met.mapInArrow(work, "u long, v long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, distance: int = 4) -> DataFrame:
    """(id, fingerprint, component_id, text_hash, kept) of every row: documents whose fingerprints differ in few bits.

    Words are runs of characters other than space and \\x09-\\x0D after lower-casing A-Z. A null or empty text has
    fingerprint zero and links like any other. Links count transitively. Copies and ties share a fingerprint and
    are compared once. component_id is a group's smallest id that is not null (null if it has none). kept marks the
    document of a group that stays: the smallest id, nulls last, then the smallest text_hash (XXH64 of the text);
    rows that repeat it are marked alike. An empty table gives none; other columns are ignored. Texts are taken
    whole, shingles are hashed in blocks.
    """
    rows = df.select(by_name(id_col).alias("id"), F.xxhash64(by_name(text_col)).alias("text_hash"), by_name(text_col).alias("t"))
    docs = written(fingerprints(rows, "t", k), "fingerprints")
    fps = docs.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"))
    fps = written(fps, "distinct")
    roots = components(links(fps.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = written(fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    known = named.drop("first").join(least, "root").select("fp", "first")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return docs.join(known, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"), "text_hash", kept.alias("kept"))


def shingles(text: bytes | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; one of all words if there are fewer than k, none without words."""
    words = (text or b"").lower().split()
    return np.unique(window_hashes(cache.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many entries each set of a has in common with each of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    values, at = np.unique(np.concatenate([*a, *b]) if a and b else np.empty(0, np.uint64), return_inverse=True)
    at_a, at_b = at[: len(of_a)], at[len(of_a) :]
    both = np.flatnonzero((np.bincount(at_a, minlength=len(values)) > 0) & (np.bincount(at_b, minlength=len(values)) > 0))
    column = np.full(len(values), -1)
    column[both] = np.arange(len(both))
    for lo in range(0, len(both), COLUMNS):
        side = []
        for of, where, n in ((of_a, column[at_a], len(a)), (of_b, column[at_b], len(b))):
            here = (where >= lo) & (where < lo + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(both) - lo)), np.float32)
            m[of[here], where[here] - lo] = 1
            side.append(m)
        out += (side[0] @ side[1].T).astype(np.int64)
    return out


def sketched(df: DataFrame, k: int) -> DataFrame:
    """df(id, th, t) without the text; fp, node (which set of shingles it is) and bands (BANDS hashes of BAND MinHash values)."""
    seeds = mixed(np.arange(1, BAND * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            fps, nodes, bands = [], [], []
            for t in b.column("t").to_pylist():
                x = shingles(t, k, cache)
                fps.append(fingerprint(t, k))
                nodes.append(xxhash.xxh64_intdigest(x.tobytes(), 3))
                least = np.array([(x * s).min() for s in seeds]) if len(x) else np.zeros(len(seeds), np.uint64)
                bands.append(np.array([xxhash.xxh64_intdigest(least[i * BAND : (i + 1) * BAND].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist())
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), signed(fps), signed(nodes), pa.array(bands, pa.list_(pa.int64()))], ["id", "th", "fp", "node", "bands"])

    schema = type(df.schema)([f for f in df.schema if f.name != "t"]).add("fp", "long").add("node", "long").add("bands", T.ArrayType(T.LongType()))
    return df.withColumn("t", F.col("t").cast("binary")).mapInArrow(work, schema)


def hashed(texts: DataFrame, k: int) -> DataFrame:
    """texts(node, t) with the text's sorted shingle hashes, as bytes, in place of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(t, k, cache).tobytes() for t in b.column("t").to_pylist()], pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(work, "node long, hashes binary")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): those of pairs(u, v) whose sets(node, hashes) have a Jaccard similarity of at least this, exactly counted."""
    side = lambda n, h: sets.select(F.col("node").alias(n), F.col("hashes").alias(h))
    full = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            a, b = (r.column(c).to_pylist() for c in ("a", "b"))
            near = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(a, b, strict=True)]
            yield r.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return full.select("u", "v", "a", "b").mapInArrow(work, "u long, v long")


def block_pairs(members: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((bucket, block, node), (bucket, a, b)): members(bucket, node, root) in blocks of bounded size, and the pairs of blocks to compare.

    Nodes with many hashes are blocks of their own, the others of a bucket are dealt by their root, those of a large root
    apart; so two blocks of one root need not meet.
    """
    m = members.join(sizes, "node")
    heavy = F.col("size") > BLOCK_HASHES // 16
    weight = F.when(heavy, 0).otherwise(F.col("size") + BLOCK_HASHES // 256)
    by_root = m.groupBy("bucket", "root").agg(F.sum(weight).alias("weight"))
    large = F.col("weight") > BLOCK_HASHES
    by_root = by_root.select("bucket", "root", F.when(large, F.ceil(F.col("weight") / BLOCK_HASHES)).alias("own"), F.when(large, 0).otherwise(F.col("weight")).alias("rest"))
    rest = by_root.groupBy("bucket").agg(F.ceil(F.sum("rest") / BLOCK_HASHES).alias("blocks"))
    at = m.join(by_root.drop("rest"), ["bucket", "root"]).join(rest, "bucket")
    dealt = F.when(heavy, F.xxhash64(F.lit(1), "node")).when(F.col("own").isNotNull(), F.xxhash64(F.lit(2), "root", F.pmod(F.xxhash64("node"), "own"))).otherwise(F.pmod(F.xxhash64("root"), F.greatest("blocks", F.lit(1))))
    at = written(at.select("bucket", dealt.alias("block"), "node", "root"), "blocks")
    cut = at.groupBy("bucket", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    side = lambda n: cut.select("bucket", F.col("block").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}"))
    one = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))
    return at, side("a").join(side("b"), "bucket").where((F.col("a") <= F.col("b")) & ~one).select("bucket", "a", "b")


def compared(members: DataFrame, sets: DataFrame, met: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, n): links of all pairs of members(bucket, node, root) with another root; n, with u and v null, counts pairs.

    Blocks of a bucket's hashes meet, a pair of blocks in a task; no pair of nodes is written down but a spanning forest of
    the links. A pair that shares several buckets(node, buckets) is compared in the least of them alone, and not at all if
    it is in met(node, met) already.
    """
    sizes = sets.select("node", (F.octet_length("hashes") / 8).cast("long").alias("size"))
    at, todo = block_pairs(members, sizes)
    todo = written(todo, "block-pairs")
    sent = todo.select("bucket", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(at, ["bucket", "block"])
    rows = sent.join(buckets, "node").join(met, "node", "left").join(sets, "node")
    rows = rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "block")

    def pairs(key: tuple, held: list[dict]) -> tuple[pa.Array, pa.Array, int]:
        bucket, a, b = key
        left, right = [r for r in held if r["block"] == a], [r for r in held if r["block"] == b]
        roots = [np.array([r["root"] for r in x]) for x in (left, right)]
        nodes = [np.array([r["node"] for r in x]) for x in (left, right)]
        ask = roots[0][:, None] != roots[1][None]
        if a == b:
            ask &= nodes[0][:, None] < nodes[1][None]
        less = [[np.array([x for x in r["buckets"] if x < bucket], np.int64).view(np.uint64) for r in x] for x in (left, right)]
        ask &= shared(*less) == 0
        done = {(r["node"], x) for r in held for x in r["met"] or ()}
        size = [np.array([len(r["hashes"]) // 8 for r in x]) for x in (left, right)]
        ask &= np.minimum(size[0][:, None], size[1][None]) >= similarity * np.maximum(size[0][:, None], size[1][None])
        for i, j in zip(*np.nonzero(ask), strict=True) if done else ():
            u, v = int(nodes[0][i]), int(nodes[1][j])
            ask[i, j] = (u, v) not in done and (v, u) not in done
        n, i, j = int(ask.sum()), np.flatnonzero(ask.any(1)), np.flatnonzero(ask.any(0))
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        set_of = [[np.frombuffer(x[q]["hashes"], np.uint64) for q in w] for x, w in ((left, i), (right, j))]
        both = shared(*set_of)
        near = ask[np.ix_(i, j)] & (both >= similarity * (size[0][i][:, None] + size[1][j][None] - both))
        x, y = np.nonzero(near)
        return *spanning(nodes[0][i[x]], nodes[1][j[y]]), n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            u, v, n = pairs(key, held)
            return pa.RecordBatch.from_arrays([pa.array([*u.tolist(), None], pa.int64()), pa.array([*v.tolist(), None], pa.int64()), pa.array([None] * len(u) + [n], pa.int64())], ["u", "v", "n"])

        key, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["bucket"], r["a"], r["b"])) != key:
                    if held:
                        yield done()
                    key, held = now, []
                held.append(r)
        if held:
            yield done()

    return rows.mapInArrow(work, "u long, v long, n long")


def stars(members: DataFrame, n: int, met: DataFrame | None) -> DataFrame:
    """(u, v): the nodes of members(bucket, node, root) with n pivots of each bucket that have another root, without met(u, v)."""
    least = [F.min(F.col("node").bitwiseXOR(F.lit(c))).bitwiseXOR(F.lit(c)).alias(f"p{i}") for i, c in enumerate(TURNS[:n])]
    pivots = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *least).where("lo < hi")
    pivots = pivots.select("bucket", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(n)]))).alias("node"))
    pivots = pivots.join(members, ["bucket", "node"]).select("bucket", F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    pairs = members.join(pivots, "bucket").where("root <> pivot_root").select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct()
    return pairs.join(met, ["u", "v"], "left_anti") if met is not None else pairs


def settled(members: DataFrame, sets: DataFrame, similarity: float, trace: list | None = None) -> DataFrame:
    """(node, root): components of all pairs of one bucket of members(bucket, node) whose sets are alike.

    First nodes meet pivots of their buckets, one and then a few, by which groups of near copies, however large, become one
    component but for stragglers. What is left, the pairs of a bucket that are in different components and have not met,
    is compared block by block, each pair once. trace, if given, gets the numbers of pairs compared in each step.
    """
    links = met = None
    m = written(members.select("bucket", "node", F.col("node").alias("root")), "members")
    for n in PIVOTS:
        pairs = written(stars(m, n, met), "stars")
        found = written(alike(pairs, sets, similarity), "alike")
        links, met = (found, pairs) if links is None else (links.unionByName(found), met.unionByName(pairs))
        roots = written(components(links), "roots")
        before, m = m, written(m.drop("root").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "members")
        drop(before)
        if trace is not None:
            trace.append(pairs.count())
    live = m.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    left = written(m.join(live, "bucket", "left_semi"), "live")
    of = written(left.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "of")
    seen = written(met.groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("met")), "met")
    more = written(compared(left, sets, seen, of, similarity), "compared")
    if trace is not None:
        trace.append(more.agg(F.sum("n")).first()[0] or 0)
    new = more.where("n is null").select("u", "v")
    out = roots if new.isEmpty() else components(links.unionByName(new))
    for t in (m, left, of, met, seen):
        drop(t)
    return out


def near_groups(df: DataFrame, id_col: str, text_col: str, k: int, distance: int, similarity: float, trace: list | None = None) -> DataFrame:
    """(id, text_hash, kept) of every row: documents joined by pairs with a k-word Jaccard similarity of at least this.

    SimHash groups within the distance, and documents that share a MinHash band (SimHash bits alone scatter too much
    at 0.8), are only candidates; what links is the exact similarity of two texts. Texts with the same shingles, and
    those without words, are one node. kept is as in simhash_groups(), trace as in settled().
    """
    rows = df.select(by_name(id_col).alias("id"), F.xxhash64(by_name(text_col)).alias("th"), by_name(text_col).alias("t"))
    docs = written(sketched(rows, k), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first")
    near = components(links(docs.select("fp").distinct(), distance)).withColumnRenamed("node", "fp")
    by_bits = docs.select("node", "fp").distinct().join(near, "fp", "left").select(F.xxhash64(F.lit(-1), F.coalesce("root", "fp")).alias("bucket"), "node")
    by_band = docs.select("node", F.posexplode("bands").alias("i", "band")).select(F.xxhash64("i", "band").alias("bucket"), "node")
    every = written(by_bits.unionByName(by_band).distinct(), "buckets")
    members = written(every.join(every.groupBy("bucket").count().where("count > 1"), "bucket", "left_semi"), "shared")
    at = docs.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("th").alias("th"))
    texts = rows.select("th", F.col("t").cast("binary").alias("t")).join(at, "th").select("node", "t")
    sets = written(hashed(texts, k).dropDuplicates(["node"]), "sets")
    roots = settled(members, sets, similarity, trace)
    named = written(docs.groupBy("node").agg(first).join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "named")
    known = named.drop("first").join(named.groupBy("root").agg(F.min("first").alias("first")), "root").select("node", "first")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    return docs.join(known, "node").select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), F.col("first.id").alias("component_id"), kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
