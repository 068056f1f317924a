"""Pieces that the corpus operators share: written tables, blobs, word hashes, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop
from ..sources.shared import folder as scratch
from ..sources.shared import table as written

__all__ = ["drop", "scratch", "written"]


def shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def save(folder: str, name: str, parts: list[np.ndarray]) -> None:
    """Writes arrays one after the other into the shared folder in one move: a task that runs twice leaves the same file."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    new = f"{path}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as f:
        for a in parts:
            f.write(np.ascontiguousarray(a).data)
            f.write(bytes(-a.nbytes % 8))
    fs.move(new, f"{path}/{name}")


#: Bytes of input for which a shard of hashes is made.
SHARD_BYTES = 16 << 20


def input_shards(df: DataFrame) -> int:
    """Shards for what comes from the rows of df: as many as shuffle partitions, more where the files behind df are large."""
    leaves, size = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        known = int(leaves.apply(i).stats().sizeInBytes())
        size += known if known < 1 << 60 else 0  # beyond that Spark does not know
    return max(shards(df.sparkSession), -(-size // SHARD_BYTES))


def by_name(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, without: set[str]) -> tuple[Column, list[Column]]:
    """(df's columns but these in one struct "row", the columns that give them back): no name of theirs meets another."""
    names = [f.name for f in df.schema if f.name not in without]
    row = F.struct(*([by_name(n).alias(n) for n in names] or [F.lit(0).alias("none")])).alias("row")
    return row, [F.col("row").getField(n).alias(n) for n in names]


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits, so that every bit range of a sum of products is uniform."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


#: Odd multiplier of the rolling window hash.
BASE = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries (none if there are fewer)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        h *= BASE
        h += words[j : len(words) - n + 1 + j]
    return mixed(h)


def pack(a: np.ndarray) -> bytes:
    """A non-decreasing uint64 array as compressed differences, byte planes apart."""
    d = np.diff(a, prepend=a[:1] * 0)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_plain(a: np.ndarray) -> bytes:
    """Any 8-byte array, compressed by byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_plain(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(dtype).ravel()


def pack_words(a: np.ndarray) -> bytes:
    """A uint64 array with repeats: its distinct values in order, and where each entry is among them."""
    values, at = np.unique(a, return_inverse=True)
    z = zstandard.ZstdCompressor(level=1)
    body = z.compress(np.ascontiguousarray(at.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())
    head = pack(values)
    return len(head).to_bytes(8, "little") + head + body


def unpack_words(b: bytes) -> np.ndarray:
    n = 8 + int.from_bytes(b[:8], "little")
    at = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[n:]), np.uint8)
    return unpack(b[8:n])[np.ascontiguousarray(at.reshape(4, -1).T).view(np.uint32).ravel()]


def shard_bounds(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal hash ranges begins in a sorted array; n + 1 entries."""
    edges = np.array([(s << 64) // n for s in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hashes, edges), len(sorted_hashes))


def contains(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that join the same nodes as the links (u, v); one a node at most."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected edges (u, v), for each node that reaches a smaller one.

    Large-star and small-star steps (Kiveris et al., 2014): each replaces a node's links by links to the least
    neighbour, found by a pre-aggregated min, never by collecting a neighbourhood. Every round's edges are written
    to the shared folder; the driver sees two numbers a round.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct()
        )
        before, e = e, written(small, "edges")
        drop(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
