"""Substring dedup by level-wise doubling of repeated windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_name, contains, input_shards, mixed, pack, pack_plain, save, scratch, shard_bounds, unpack, unpack_plain, window_hashes, written

#: Bytes of text in a chunk: a task's unit, written once and read once a level.
CHUNK = 2 << 20
#: Levels begin at this length or below it.
SHORTEST = 4
#: Stands for a null id: no id is larger.
NO_ID = np.iinfo(np.int64).max
#: Bytes that are hashed in one go (a longer word is one of its own), and the odd multiplier of words' hashes.
BLOCK, STEP = 1 << 22, 0xC2B2AE3D27D4EB4F

CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("ends", pa.binary()), ("texts", pa.binary())])
ASK = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary())])
TELL = pa.schema([("home", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("asked", pa.int64())])


def levels(window: int) -> list[int]:
    """Window lengths from the first that is looked at to the last: each at most doubles, the last is exact."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def chunked(df: DataFrame) -> DataFrame:
    """Rows of df(id, text as binary) packed into chunks of about CHUNK bytes (a longer text is one of its own)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def packed() -> pa.RecordBatch:
            ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
            body = zstandard.ZstdCompressor(level=3).compress(b"\n".join([*(t or b"" for t in texts), b""]))
            key = np.array([NO_ID if i is None else i for i in ids], np.int64)
            return pa.RecordBatch.from_pylist([{"chunk": part + n, "ids": key.tobytes(), "nulls": bytes(i is None for i in ids), "ends": ends.tobytes(), "texts": body}], CHUNK_SCHEMA)

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if texts and size + len(t or b"") > CHUNK:
                    yield packed()
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
        if ids:
            yield packed()

    return df.mapInArrow(work, "chunk long, ids binary, nulls binary, ends binary, texts binary")


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse modulo 2 ** 64 for i below n."""
    up, down = np.full(n, STEP, np.uint64), np.full(n, pow(STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a buffer: polynomials of their bytes by prefix sums, mixed with their length."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, side="right")))
        hi = int(ends[to - 1])
        size = max(BLOCK, hi - lo)
        up, down = powers(size)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((text[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = to
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Chunk:
    """A chunk's words: where they are, their hashes, the row each belongs to; rows are parted by white space."""

    def __init__(self, row: dict):
        self.chunk, self.ids, self.nulls = row["chunk"], np.frombuffer(row["ids"], np.int64), row["nulls"]
        row_ends = np.frombuffer(row["ends"], np.int64)
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
        space = _SPACE[self.text]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.append(0, edge)
        self.starts, self.ends = edge[::2], edge[1::2]  # the text ends with white space
        self.first = np.append(0, np.searchsorted(self.starts, row_ends))  # word with which each row begins
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.hashes = word_hashes(self.text, self.starts, self.ends)

    def whole(self, window: int) -> np.ndarray:
        """Which windows lie in one row."""
        n = max(0, len(self.starts) - window + 1)
        return np.arange(n) + window <= self.first[1:][self.row[:n]]

    def anchors(self, length: int, window: int) -> np.ndarray:
        """The least hash of `length` words in each window: equal windows have equal anchors."""
        x, span = window_hashes(self.hashes, length), window - length + 1
        done = 1
        while done < span and len(x):
            step = min(done, span - done)
            x = np.minimum(x[: max(0, len(x) - step)], x[step:])
            done += step
        return x


def least(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, their smallest owner, and whether they have several owners."""
    if not len(hashes):
        return hashes, owners, np.empty(0, bool)
    order = np.argsort(hashes)
    hashes, owners = hashes[order], owners[order]
    head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    lowest = np.minimum.reduceat(owners, head)
    return hashes[head], lowest, np.maximum.reduceat(owners, head) != lowest


class Answers:
    """The answers to a level's questions: a file for each partition of chunks in the shared folder, in which a chunk finds its own."""

    def __init__(self, folder: str, length: int):
        self.folder, self.length = folder, length

    def of(self, chunk: int) -> np.ndarray:
        at, blobs = _file(self.folder, f"{self.length}-{chunk >> 32}")
        own = np.flatnonzero(at[:, 0] == chunk)
        return np.sort(np.concatenate([unpack(blobs[at[k, 1] : at[k, 2]].tobytes()) for k in own])) if len(own) else np.empty(0, np.uint64)


@lru_cache(8)
def _file(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    fs, path = pafs.FileSystem.from_uri(folder)
    try:
        with fs.open_input_stream(f"{path}/{name}") as f:
            raw = np.frombuffer(f.read(), np.uint8)
    except FileNotFoundError:  # none of the partition's chunks has asked
        return np.empty((0, 3), np.int64), np.empty(0, np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    return raw[8 : 8 + 24 * n].view(np.int64).reshape(n, 3), raw[8 + 24 * n :]


def ask(chunks: DataFrame, window: int, length: int, before: Answers | None, n: int) -> DataFrame:
    """What chunks ask at one level: hashes of the windows of `length` words that can still matter, by ranges of hashes.

    At the first level those are the anchors of the final windows. Later ones are extended from windows of which the
    answer was that they repeat.
    """
    last = length == window

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                keep = c.whole(window)
                if before:
                    keep &= contains(before.of(c.chunk), c.anchors(before.length, window))
                at = np.flatnonzero(keep)
                h, lowest, several = least(c.anchors(length, window)[at], c.ids[c.row[at]])
                own, edges = lowest if last else several.astype(np.int64), shard_bounds(h, n)
                rows = [{"shard": s, "chunk": c.chunk, "hashes": pack(h[x:y]), "owners": pack_plain(own[x:y])} for s, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ASK)

    return chunks.mapInArrow(work, "shard int, chunk long, hashes binary, owners binary")


def answer(questions: DataFrame, last: bool, n: int) -> DataFrame:
    """(home, chunk, hashes, asked): for each chunk those of its hashes that other texts have as well.

    Before the last level a hash counts if two ids have it (owners holds a flag: several ids in the chunk itself); at
    the last, if a chunk has it with a smaller id than this chunk's smallest. A partition is a range of hashes, all
    equal in size, and a chunk names a hash once, so no group is hot.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        hashes = [unpack(r["hashes"]) for r in rows]
        own = np.concatenate([unpack_plain(r["owners"], np.int64) for r in rows])
        every = np.concatenate(hashes)
        order = np.argsort(every)
        values, own = every[order], own[order]
        head = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        size = np.diff(np.append(head, len(values)))
        said = np.repeat(np.minimum.reduceat(own, head), size) < own if last else np.repeat((size > 1) | (np.maximum.reduceat(own, head) > 0), size)
        back = np.empty(len(every), bool)
        back[order] = said
        out, lo = [], 0
        for r, h in zip(rows, hashes, strict=True):
            got = h[back[lo : lo + len(h)]]
            lo += len(h)
            out.append({"home": r["chunk"] >> 32, "chunk": r["chunk"], "hashes": pack(got) if len(got) else None, "asked": len(h)})
            if len(out) == 512:
                yield pa.RecordBatch.from_pylist(out, TELL)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, TELL)

    return questions.repartitionById(n, F.col("shard")).mapInArrow(work, "home int, chunk long, hashes binary, asked long")


def stored(answers: DataFrame, folder: str, length: int, n: int) -> tuple[Answers, tuple[int, int]]:
    """The answers as files, and how many hashes were asked for and were found to repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                homes.setdefault(r["home"], []).append(r)
        out = []
        for home, rows in homes.items():
            told = [r for r in rows if r["hashes"]]
            ends = np.cumsum([len(r["hashes"]) for r in told], dtype=np.int64)
            head = np.array([len(told), *(x for r, e in zip(told, ends.tolist(), strict=True) for x in (r["chunk"], e - len(r["hashes"]), e))], np.int64)
            save(folder, f"{length}-{home}", [head, np.frombuffer(b"".join(r["hashes"] for r in told), np.uint8)])
            out.append({"asked": sum(r["asked"] for r in rows), "found": sum(len(unpack(r["hashes"])) for r in told)})
        if out:
            yield pa.RecordBatch.from_pylist(out)

    counts = answers.repartition(n, "home").mapInArrow(work, "asked long, found long").agg(F.sum("asked"), F.sum("found")).first()
    return Answers(folder, length), (counts[0] or 0, counts[1] or 0)


def left_over(c: Chunk, gone: np.ndarray, window: int) -> pa.RecordBatch:
    """A chunk's rows without the words that the windows marked in gone cover."""
    n = len(c.starts)
    begun = np.zeros(n + 1, np.int64)
    begun[1 : len(gone) + 1] = gone
    begun = np.cumsum(begun)
    upto = np.minimum(np.arange(n) + 1, len(gone))  # windows that begin at a word or before it, less those that end before it
    kept = np.flatnonzero(begun[upto] == begun[np.minimum(np.maximum(np.arange(n) + 1 - window, 0), len(gone))])
    last = np.append(c.row[kept][1:] != c.row[kept][:-1], True)[: len(kept)]
    # Bytes of the words that are kept, each but a row's last with the white space after it, as one space.
    text = c.text.copy()
    text[c.ends[kept]] = 32
    mark = np.zeros(len(text) + 1, np.int8)
    np.add.at(mark, c.starts[kept], 1)
    np.add.at(mark, c.ends[kept] + ~last, -1)
    sizes = np.bincount(c.row[kept], c.ends[kept] - c.starts[kept] + ~last, len(c.ids)).astype(np.int64)
    data = text[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    words = np.diff(c.first)
    ids = pa.array(c.ids, mask=np.frombuffer(c.nulls, np.uint8) > 0)
    texts = pa.Array.from_buffers(pa.binary(), len(c.ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(words - np.bincount(c.row[kept], minlength=len(c.ids))), texts], ["id", "n_words", "n_removed", "kept"])


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, trace: list | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept): every text without the words in windows that a smaller id's text also has.

    Level-wise: windows of a few words are looked at first, the length then doubles up to `window`, and only windows
    that repeat at one length are extended to the next. At the lengths below the last a text names, for each final
    window, just the least hash in it (its anchor): if the final window repeats, so does its anchor, hence nothing
    is lost and a fraction of the windows travels. Texts are packed into chunks that are written once and never move;
    a chunk asks the ranges of hashes which of its own repeat, and finds the answers in a file of the shared folder.
    The number of ranges follows the input's size. All windows are judged on the input.

    kept is the words left, joined by one space, as binary. A null text has no words; texts shorter than a window
    lose nothing; very long ones are a chunk of their own, hashed block by block. A null id counts as larger than
    every other, rows with equal ids do not take from each other, so repeated rows keep what they have. An empty table
    gives none. Other columns are ignored. Words and windows are compared by 64-bit hashes. trace, if given, gets
    (length, hashes asked for, hashes that repeat) of each level.
    """
    n, folder = input_shards(df), scratch(df.sparkSession, "answers")
    chunks = written(chunked(df.select(by_name(id_col).cast("long").alias("id"), by_name(text_col).cast("binary").alias("text"))), "chunks")
    answers = None
    for length in levels(window):
        answers, counts = stored(answer(ask(chunks, window, length, answers, n), length == window, n), folder, length, n)
        if trace is not None:
            trace.append((length, *counts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                x, whole = c.anchors(window, window), c.whole(window)
                gone = contains(answers.of(c.chunk), x)
                at = np.flatnonzero(whole)
                h, lowest, several = least(x[at], c.ids[c.row[at]])
                inside = h[several]
                if len(inside):
                    own = np.flatnonzero(contains(inside, x) & whole)
                    gone[own] |= lowest[several][np.searchsorted(inside, x[own])] < c.ids[c.row[own]]
                yield left_over(c, gone & whole, window)

    out = chunks.mapInArrow(work, "id long, n_words long, n_removed long, kept binary")
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
