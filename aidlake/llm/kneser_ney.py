"""Language-model scoring: interpolated modified Kneser-Ney, counted in Spark, memory-mapped by workers."""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, WordHashes, by_name, carried, contains, input_shards, mixed, pack, save, scratch, unpack, window_hashes
from .toxicity import fold

#: Words of an n-gram that the query counts.
ORDER = 3
#: Tokens that a task counts before it sends them on, and that it scores at once.
COUNTED, SCORED = 4_000_000, 1_000_000
#: A core is hot if over this part of a shard's mean share of the n-grams has it; texts of which one in SAMPLED is looked at for that.
HOT, SAMPLED = 0.5, 32
#: Entries of a table that share a place in its index, on average.
PLACE = 16
#: Where tables cannot be mapped: bytes of a page, bytes of pages that a process keeps, pages read at once.
PAGE, KEPT, RUN = 1 << 16, 256 << 20, 64
#: Bits of a word's 64-bit hash that n-grams leave out; single words are counted by all of them.
LESS = np.uint64(16)

BEGIN = np.uint64(xxhash.xxh64_intdigest(b"begin", 1))
END = np.uint64(xxhash.xxh64_intdigest(b"end", 1))

PART = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("shard", pa.int32()), ("words", pa.list_(pa.binary())), ("numbers", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64()))])
PART_DDL = "kind string, level int, shard int, words array<binary>, numbers array<binary>, stats array<long>"


def tokens(text: bytes | None, cache: WordHashes, order: int) -> np.ndarray:
    """Hashes of a text's words after order - 1 begin marks, then the end mark."""
    words = (text or b"").lower().split()
    out = np.empty(len(words) + order, np.uint64)
    out[: order - 1], out[-1] = BEGIN, END
    out[order - 1 : -1] = cache.of(words)
    return out


def gram_hash(cols: list[np.ndarray]) -> np.ndarray:
    """What window_hashes() gives for these words side by side."""
    h = cols[0].copy()
    for c in cols[1:]:
        h = h * BASE + c
    return mixed(h)


def core_hash(cols: list[np.ndarray]) -> np.ndarray:
    """By what the n-grams with these inner words are dealt out."""
    return cols[0] << LESS if len(cols) == 1 else gram_hash(cols)


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The one of n equal ranges of hashes that holds each."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def ordering(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows of small numbers, the first column most significant; where each distinct row begins in it)."""
    size, key = 1, None
    for c in cols:
        size *= int(c.max(initial=0)) + 1
    if size < 1 << 63:
        key = cols[0].astype(np.int64)
        for c in cols[1:]:
            key = key * (int(c.max(initial=0)) + 1) + c
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(cols[::-1])
        new = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in cols])
    return order, np.flatnonzero(np.append(len(order) > 0, new)) if len(order) else np.empty(0, np.int64)


def by_core(level: int) -> list[int]:
    """Columns of an n-gram from the most significant: its core (all but the outer words), the first, the last."""
    return [*range(1, level - 1), 0, level - 1]


def encoded(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them, byte planes apart, compressed."""
    most = int(a.max(initial=0))
    a = a.astype(next(f"u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w))
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return bytes([a.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def decoded(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(b[0], -1).T).view(f"u{b[0]}").ravel()


def packed_grams(words: np.ndarray, cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(distinct words and columns, counts) of n-grams as blobs; their order is not kept.

    Words are numbered by how often they are there, roughly, so that numbers are small; rows are put in order, and a
    column's numbers are counted on from the row above where all columns before it agree.
    """
    used = np.unique(np.concatenate(cols))
    own = [np.searchsorted(used, c) for c in cols]
    rough = -np.log2(np.maximum(sum(np.bincount(c, minlength=len(used)) for c in own), 1)).astype(np.int64)
    by = np.argsort(rough, kind="stable")
    rank = np.empty(len(used), np.int64)
    rank[by] = np.arange(len(used))
    own, values = [rank[c] for c in own], words[used[by]]
    order, _ = ordering([own[j] for j in by_core(len(own))])
    packed, new = {}, np.zeros(len(order), bool)
    new[:1] = True
    for j in by_core(len(own)):
        c = own[j][order]
        steps = np.diff(c, prepend=0)
        packed[j] = encoded(np.where(new, c, steps))
        new |= steps != 0
    return [encoded(np.diff(values, prepend=values[:1] * 0)), *(packed[j] for j in range(len(own)))], [encoded(counts[order])]


def unpacked_grams(blobs: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words, columns of places in them) of packed_grams()."""
    values = np.cumsum(decoded(blobs[0]).astype(np.uint64), dtype=np.uint64)
    cols: list[np.ndarray] = [values] * (len(blobs) - 1)
    new = None
    for j in by_core(len(cols)):
        steps = decoded(blobs[1 + j]).astype(np.int64)
        if new is None:
            new = np.arange(len(steps)) == 0
        upto = np.cumsum(steps)
        heads = np.flatnonzero(new)
        c = cols[j] = upto - np.repeat((upto - steps)[heads], np.diff(np.append(heads, len(steps))))
        new = new | (np.diff(c, prepend=0) != 0)
    return values, cols


def dealt(shard: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its rows in their order) of each shard that has rows."""
    o = np.argsort(shard, kind="stable")
    own = shard[o]
    heads = np.flatnonzero(np.append(len(own) > 0, own[1:] != own[:-1])) if len(own) else []
    for a, b in zip(heads, np.append(heads[1:], len(own)), strict=True):
        yield int(own[a]), o[a:b]


def row(kind: str, level: int, shard: int, words=None, numbers=None, stats=None) -> dict:
    return {"kind": kind, "level": level, "shard": shard, "words": words, "numbers": numbers, "stats": stats}


def gram_parts(kind: str, level: int, words: np.ndarray, cols: list[np.ndarray], counts: np.ndarray, shard: np.ndarray, n: int) -> list[dict]:
    """n-grams of places in words, as a blob for each shard."""
    return [row(kind, level, s, *packed_grams(words, [c[i] for c in cols], counts[i])) for s, i in dealt(shard, n)]


def key_parts(kind: str, level: int, hashes: np.ndarray, numbers: list[np.ndarray], n: int) -> list[dict]:
    """Numbers by hash (in order), as blobs for the shards."""
    return [row(kind, level, s, [pack(hashes[i])], [encoded(x[i]) for x in numbers]) for s, i in dealt(shard_of(hashes, n), n)]


def counted(df: DataFrame, order: int, n: int, hot: list[np.ndarray]) -> DataFrame:
    """Partial counts of the texts' n-grams and tokens, as blobs by shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, docs, size = WordHashes(), [], 0

        def sent() -> pa.RecordBatch:
            ends, flat = np.cumsum([len(d) for d in docs]), np.concatenate(docs)
            docs.clear()
            words, at = np.unique(flat, return_inverse=True)
            at = at.astype(np.int32)
            del flat
            inside = np.ones(len(at) - order + 1, bool)  # n-grams that begin here do not cross into the next text
            for e in ends[:-1].tolist():
                inside[max(0, e - order + 1) : e] = False
            cols = [at[j : len(at) - order + 1 + j][inside] for j in range(order)]
            rows = key_parts("raw", 1, *keyed(words, cols[-1]), n)
            o, heads = ordering([cols[j] for j in by_core(order)])
            counts, words = np.diff(np.append(heads, len(o))), words >> LESS
            o = o[heads]
            cols = [c[o] for c in cols]
            shard, _ = routed(words, cols, hot[order], n)
            return pa.RecordBatch.from_pylist(rows + gram_parts("gram", order, words, cols, counts, shard, n), PART)

        for b in batches:
            for t in b.column(0).to_pylist():
                docs.append(tokens(t, cache, order))
                size += len(docs[-1])
                if size >= COUNTED:
                    yield sent()
                    size = 0
        if docs:
            yield sent()

    return df.mapInArrow(work, PART_DDL)


def keyed(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hashes in order, [counts]) of the words at these places."""
    count = np.bincount(at, minlength=len(words))
    used = np.flatnonzero(count)
    h = mixed(words[used])
    o = np.argsort(h)
    return h[o], [count[used][o]]


def routed(words: np.ndarray, cols: list[np.ndarray], hot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, whether its core is hot) of n-grams: by core, but by the whole n-gram for hot cores."""
    core = [words[c] for c in cols[1:-1]]
    h = core_hash(core) if core else np.zeros(len(cols[0]), np.uint64)
    is_hot = contains(hot, h) if core else np.ones(len(h), bool)
    shard = shard_of(h, n)
    shard[is_hot] = shard_of(gram_hash([words[c[is_hot]] for c in cols]), n)
    return shard, is_hot


def coded(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows of the numbers, the place of each row among them)."""
    few = 4 if len(numbers) > 1 else 16  # bits that most numbers fit in
    small = np.logical_and.reduce([x < 1 << few for x in numbers])
    key = np.zeros(len(small), np.int64)
    for x in numbers:
        key = key << few | np.where(small, x, 0).astype(np.int64)
    used = np.flatnonzero(np.bincount(key[small], minlength=1))
    rows = [np.stack([used >> few * (len(numbers) - 1 - j) & (1 << few) - 1 for j in range(len(numbers))], 1)]
    place = np.searchsorted(used, key)
    if not small.all():
        others, at = np.unique(np.stack([x[~small].astype(np.int64) for x in numbers], 1), axis=0, return_inverse=True)
        rows.append(others)
        place[~small] = len(used) + at.ravel()
    return np.concatenate(rows).astype(np.int64), place


def table(hashes: np.ndarray, numbers: list[np.ndarray]) -> list[np.ndarray]:
    """A sorted hash array and its numbers, as arrays to be written one after the other.

    Head; the commonest row of numbers and the other distinct ones; then, for the hashes with the commonest row and for
    the others: an index by the leading bits, the next 32 bits of each hash, for the others the places of their rows.
    For an n-gram that was never counted, one in 2**32 / PLACE lookups finds a stranger's numbers.
    """
    rows, place = coded(numbers)
    first = int(np.argmax(np.bincount(place)))
    swap = np.arange(len(rows))
    swap[[0, first]] = swap[[first, 0]]
    rows, place = rows[swap], swap[place]
    small = next(f"u{w}" for w in (1, 2, 4) if len(rows) <= 1 << 8 * w)
    head, parts = [len(rows), len(numbers), int(small[1])], [rows]
    for own in (place == 0, place > 0):
        h = hashes[own]
        bits = max(1, (len(h) // PLACE).bit_length())
        index = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        head += [len(h), bits]
        parts += [index.astype(np.uint32), (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)]
    return [np.array(head, np.int64), *parts, place[place > 0].astype(small)]


class Keys:
    """One of a table's two sorted hash arrays."""

    def __init__(self, bits: int, index: np.ndarray, keys: np.ndarray):
        self.bits, self.index, self.keys = bits, index, keys

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are there; where): a binary search in each one's place of the index."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        top = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        lo, end = self.index[top].astype(np.int64), self.index[top + 1].astype(np.int64)
        want, hi = (hashes << np.uint64(self.bits) >> np.uint64(32)).astype(np.uint32), end.copy()
        for _ in range(int((end - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            less = self.keys[np.minimum(mid, len(self.keys) - 1)] < want
            less &= lo < hi
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        hit = np.flatnonzero(lo < end)
        hit = hit[self.keys[lo[hit]] == want[hit]]
        return hit, lo[hit]


class Pages:
    """Files read page by page as their numbers are asked for: what a memory map does, for a store that has none.

    A process keeps KEPT bytes of pages at most, those used last, and reads RUN pages at once where they follow each other.
    """

    def __init__(self):
        self.pages, self.files = OrderedDict(), OrderedDict()

    def wanted(self, fs: pafs.FileSystem, path: str, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(number, bytes) of each of a file's pages, given by ascending numbers."""
        for lo in range(0, len(numbers), RUN):
            todo = numbers[lo : lo + RUN].tolist()
            missing = [n for n in todo if (path, n) not in self.pages]
            for i, first in enumerate(missing):
                if i and missing[i - 1] == first - 1:
                    continue
                last = next((j for j in range(i, len(missing)) if missing[j] - first != j - i), len(missing)) - 1
                raw = self.file(fs, path).read_at((missing[last] - first + 1) * PAGE, first * PAGE)
                for n in range(first, missing[last] + 1):  # copied, so that a page does not keep its whole run
                    self.pages[path, n] = np.frombuffer(raw, np.uint8)[(n - first) * PAGE :][:PAGE].copy()
            for n in todo:
                self.pages.move_to_end((path, n))
                yield n, self.pages[path, n]
            while len(self.pages) * PAGE > KEPT:
                self.pages.popitem(last=False)

    def file(self, fs: pafs.FileSystem, path: str) -> pa.NativeFile:
        if path not in self.files:
            self.files[path] = fs.open_input_file(path)
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(path)
        return self.files[path]


PAGES = Pages()


class Paged:
    """Numbers of one kind in a stored file, to be taken by their places as from an array. They never lie on two pages."""

    def __init__(self, fs: pafs.FileSystem, path: str, start: int, count: int, kind: str):
        self.fs, self.path, self.start, self.count, self.kind = fs, path, start, count, np.dtype(kind)

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        size = self.kind.itemsize
        place = self.start // size + np.asarray(at, np.int64).ravel()
        page, place = np.divmod(place, PAGE // size)
        o = np.argsort(page, kind="stable")
        numbers, heads = np.unique(page[o], return_index=True)
        out = np.empty(len(o), self.kind)
        for (_, raw), i in zip(PAGES.wanted(self.fs, self.path, numbers), np.split(o, heads[1:]), strict=False):
            out[i] = raw.view(self.kind)[place[i]]
        return out.reshape(np.shape(at))


class Table:
    """A stored table, its bytes from a mapped file or its numbers page by page (part(start, count, kind)): it is never loaded whole."""

    def __init__(self, raw: np.ndarray | Callable[[int, int, str], Paged]):
        part = raw if callable(raw) else lambda lo, count, kind: raw[lo : lo + count * int(kind[1:])].view(kind)
        rows, self.width, small, n0, bits0, n1, bits1 = part(0, 7, "i8")[np.arange(7)].tolist()
        at = 56

        def following(count: int, kind: str) -> np.ndarray | Paged:
            nonlocal at
            lo, at = at, at + -(-count * int(kind[1:]) // 8) * 8
            return part(lo, count, kind)

        self.rows = following(rows * self.width, "i8")
        self.common = Keys(bits0, following((1 << bits0) + 1, "u4"), following(n0, "u4"))
        self.other = Keys(bits1, following((1 << bits1) + 1, "u4"), following(n1, "u4"))
        self.place = following(n1, f"u{small}")

    def numbers(self, at: np.ndarray) -> np.ndarray:
        return self.rows[at.astype(np.int64)[:, None] * self.width + np.arange(self.width)]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are there, their numbers)."""
        a, _ = self.common.find(hashes)
        b, at = self.other.find(hashes)
        return np.append(a, b), np.concatenate([np.broadcast_to(self.numbers(np.zeros(1)), (len(a), self.width)), self.numbers(self.place[at])])


@lru_cache(2048)
def load(folder: str, name: str) -> Table | None:
    """A table of the shared folder: memory-mapped, or read page by page from a store that cannot be. None if a shard has none."""
    fs, path = pafs.FileSystem.from_uri(folder)
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            return Table(np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r")))  # still mapped, but a plain array's indexing is quicker
        return Table(lambda lo, count, kind: Paged(fs, f"{path}/{name}", lo, count, kind))
    except FileNotFoundError:
        return None


class Shard:
    """What one task does with its share at a stage: tables that are whole are saved, the rest is sent on."""

    def __init__(self, shard: int, folder: str, n: int, order: int, hot: list[np.ndarray]):
        self.shard, self.folder, self.n, self.order, self.hot, self.out = shard, folder, n, order, hot, []

    def store(self, kind: str, level: int, hashes: np.ndarray, numbers: list[np.ndarray], stats: list[int] | None = None) -> None:
        o = np.argsort(hashes)
        if len(o):
            save(self.folder, f"{kind}{level}-{self.shard}", table(hashes[o], [x[o] for x in numbers]))
            self.out.append(row(f"done-{kind}", level, self.shard, stats=stats or []))

    @staticmethod
    def stats(c: np.ndarray) -> list[int]:
        return [len(c), int(c.sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4)), int((c > 2).sum())]

    @staticmethod
    def merged(rows: list[dict], level: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(words, distinct n-grams in the order of by_core(), summed counts) of blobs."""
        blobs = [unpacked_grams(r["words"]) for r in rows]
        words = np.unique(np.concatenate([d for d, _ in blobs]))
        places = [np.searchsorted(words, d).astype(np.int32) for d, _ in blobs]
        cols = [np.concatenate([p[c[j]] for p, (_, c) in zip(places, blobs, strict=True)]) for j in range(level)]
        del blobs
        counts = np.concatenate([decoded(r["numbers"][0]).astype(np.int64) for r in rows])
        o, heads = ordering([cols[j] for j in by_core(level)])
        return words, [c[o[heads]] for c in cols], np.add.reduceat(counts[o], heads)

    @staticmethod
    def summed(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(hashes in order, summed numbers) of blobs of numbers by hash."""
        h = np.concatenate([unpack(r["words"][0]) for r in rows])
        o = np.argsort(h)
        h = h[o]
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[heads], [np.add.reduceat(np.concatenate([decoded(r["numbers"][j]).astype(np.int64) for r in rows])[o], heads) for j in range(len(rows[0]["numbers"]))]

    def contexts(self, kind: str, level: int, words: np.ndarray, cols: list[np.ndarray], counts: np.ndarray, send: bool) -> None:
        """What follows each context of n-grams whose columns but the last run in order: total, once, twice, more often."""
        if not len(counts):
            return
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:-1]])
        heads = np.flatnonzero(np.append(True, new))
        h = gram_hash([words[c[heads]] for c in cols[:-1]])
        numbers = [np.add.reduceat(x.astype(np.int64), heads) for x in (counts, counts == 1, counts == 2, counts > 2)]
        if send:
            o = np.argsort(h)
            self.out += key_parts(kind, level, h[o], [x[o] for x in numbers], self.n)
        else:
            self.store(kind, level, h, numbers)

    def passed_on(self, level: int, words: np.ndarray, cols: list[np.ndarray]) -> None:
        """Sends distinct n-grams to where the shorter ones at their end are counted."""
        if not len(cols[0]):
            return
        if level == 2:
            self.out += key_parts("word", 1, *keyed(words, cols[1]), self.n)
        elif level > 2:
            shard, _ = routed(words, cols, self.hot[level], self.n)
            self.out += gram_parts("gram", level, words, cols, np.ones(len(shard), np.int64), shard, self.n)

    def grams(self, level: int, rows: list[dict]) -> None:
        """All n-grams of each core that is not hot, and some of each hot one."""
        words, cols, counts = self.merged(rows, level)
        _, hot = routed(words, cols, self.hot[level], self.n)
        if level == self.order:
            self.store("gram", level, gram_hash([words[c] for c in cols]), [counts], self.stats(counts))
        for own, whole in ((~hot, True), (hot, False)):
            part = [c[own] for c in cols]
            if not own.any():
                continue
            if level == self.order:
                self.contexts("context", level, words, part, counts[own], not whole)
            o, heads = ordering([part[j] for j in range(1, level)])
            short, before = [c[o[heads]] for c in part[1:]], np.diff(np.append(heads, len(o)))
            if level == 2:
                self.passed_on(2, words, part)
            elif whole:
                self.store("gram", level - 1, gram_hash([words[c] for c in short]), [before], self.stats(before))
                self.contexts("context", level - 1, words, short, before, False)
                self.passed_on(level - 1, words, short)
            else:
                h = gram_hash([words[c] for c in short])
                self.out += gram_parts("part", level - 1, words, short, before, shard_of(h, self.n), self.n)

    def parts(self, level: int, rows: list[dict]) -> None:
        """n-grams whose counts come from several shards."""
        words, cols, counts = self.merged(rows, level)
        self.store("hot-gram", level, gram_hash([words[c] for c in cols]), [counts], self.stats(counts))
        o, _ = ordering(cols)
        self.contexts("context", level, words, [c[o] for c in cols], counts[o], True)
        self.passed_on(level, words, cols)


def stage(rows: DataFrame, kind: str, level: int, folder: str, n: int, order: int, hot: list[np.ndarray]) -> DataFrame:
    """One exchange, by core, by hash or of words; each task has a shard, gives on what it does not settle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, shard = defaultdict(list), -1
        for b in batches:
            for r in b.to_pylist():
                shard = r["shard"]
                groups[r["kind"], r["level"]].append(r)
        s = Shard(shard, folder, n, order, hot)
        for (k, l), found in groups.items():
            if kind == "core" and (k, l) == ("gram", level):
                s.grams(l, found)
            elif k == "raw":
                h, (c,) = s.summed(found)
                s.store("raw", 1, h, [c], s.stats(c))
            elif kind == "hash" and (k, l) == ("part", level - 1):
                s.parts(l, found)
            elif k == "context" and (kind, l) in (("hash", level), ("words", 2)):
                s.store("hot-context", l, *s.summed(found))
            elif kind != "core" and k == "word":
                h, (c,) = s.summed(found)
                if kind == "hash":
                    s.out += key_parts("word", 1, h, [c], n)
                else:
                    s.store("hot-gram", 1, h, [c], s.stats(c))
            else:
                s.out += found
        for lo in range(0, len(s.out), 256):
            yield pa.RecordBatch.from_pylist(s.out[lo : lo + 256], PART)

    return rows.repartitionById(n, F.col("shard")).mapInArrow(work, PART_DDL)


def hot_cores(texts: DataFrame, order: int, n: int) -> list[np.ndarray]:
    """By length of n-gram, the hashes of cores that so many n-grams have that a shard could not take them all.

    Looked for in one text of SAMPLED where the input is large. This only says where rows are dealt to: counts are
    exact whatever cores are in the list, and there are fewer than n / HOT in it for each length.
    """
    if order < 3:
        return [np.empty(0, np.uint64)] * (order + 1)
    some = texts.sample(1 / SAMPLED, seed=1) if n > 8 else texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            docs = [tokens(t, cache, order) >> LESS for t in b.column(0).to_pylist()]
            for level in range(3, order + 1):
                core = [d << LESS if level == 3 else window_hashes(d, level - 2) for d in docs]
                h, c = np.unique(np.concatenate(core), return_counts=True)
                kept = c * n * 8 > c.sum() * HOT  # rarer ones in this batch of texts count as none
                yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum() + 1, level, np.int32)), pa.array([None, *h[kept].view(np.int64).tolist()], pa.int64()), pa.array([int(c.sum()), *c[kept].tolist()], pa.int64())], ["level", "core", "n"])

    counts = some.mapInArrow(work, "level int, core long, n long").groupBy("level", "core").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.col("core").isNotNull(), F.desc("n")).limit(order + int(order * n / HOT)).collect()
    total = {r["level"]: r["n"] for r in found if r["core"] is None}
    return [np.sort(np.array([r["core"] for r in found if r["core"] is not None and r["level"] == k and r["n"] * n > total[k] * HOT], np.int64).view(np.uint64)) for k in range(order + 1)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from how many n-grams occur once to four times."""
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, where one of each is, which of them each one is). Any will do, so the sort need not be stable."""
    o = np.argsort(h)
    ordered = h[o]
    new = np.append(np.ones(min(len(h), 1), bool), ordered[1:] != ordered[:-1])
    which = np.empty(len(h), np.int64)
    which[o] = np.cumsum(new) - 1
    return ordered[new], o[new], which


class Model:
    """Where the tables are, and the few numbers that go with them. Pickled to the workers; holds no table."""

    def __init__(self, folder: str, order: int, n: int, hot: list[np.ndarray], have: set[tuple[str, int]], stats: dict[tuple[str, int], list[int]]):
        self.folder, self.order, self.n, self.hot, self.have = folder, order, n, hot, have
        self.train_tokens, self.distinct = (stats.get(("raw", 1)) or [0, 0])[1], (stats.get(("raw", 1)) or [0])[0]
        grams = {k: np.sum([s for (kind, l), s in stats.items() if l == k and kind in ("gram", "hot-gram")], 0).tolist() for kind, k in stats if kind in ("gram", "hot-gram")}
        self.discount = {k: discounts(*s[2:6]) for k, s in grams.items()}
        self.uniform, self.total = 1.0, 0
        if 1 in grams:
            one = grams[1]
            self.total = one[1]
            self.uniform = sum(d * c for d, c in zip(self.discount[1], (one[2], one[3], one[6]), strict=True)) / one[1]

    def lookup(self, kind: str, level: int, hashes: np.ndarray, core: np.ndarray | None, width: int = 1) -> np.ndarray:
        """Rows of the numbers of hashes (in order), 0 where there are none: each shard's table is walked once, in order."""
        out = np.zeros((len(hashes), width))
        hot = np.ones(len(hashes), bool) if core is None else contains(self.hot[level if level == self.order else level + 1], core)
        apart = "" if kind == "raw" or (kind, level) == ("gram", self.order) else "hot-"
        for own, name, by in ((~hot, kind, core), (hot, apart + kind, hashes)):
            rows = np.flatnonzero(own)
            if len(rows) and (name, level) in self.have:
                for s, i in dealt(shard_of(by[rows], self.n), self.n):
                    if found := load(self.folder, f"{name}{level}-{s}"):
                        hit, numbers = found.find(hashes[rows[i]])
                        out[rows[i][hit]] = numbers
        return out

    def probabilities(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(probability, training count) of every token of the texts, one after the other."""
        order = self.order
        last, _, inv = distinct(mixed(np.concatenate([d[order - 1 :] for d in docs])))
        raw = self.lookup("raw", 1, last, None)[:, 0][inv]
        docs = [d >> LESS for d in docs]
        last, _, inv = distinct(mixed(np.concatenate([d[order - 1 :] for d in docs])))
        p = np.full(len(last), 1 / (self.distinct + 1))
        if self.total:
            c = self.lookup("gram", 1, last, None)[:, 0]
            p = self._less(c, 1) / self.total + self.uniform * p
        p = p[inv]
        for k in range(2, order + 1):
            own = [d[order - k :] for d in docs]  # its windows of k words end with each token in turn
            inner = 1 if k == order else 0
            size = k - 1 - inner  # words of the core: all of the context, without its first word at the highest order
            core = None
            if size:
                core = np.concatenate([d[inner : len(d) - k + inner + 1] << LESS if size == 1 else window_hashes(d[inner : len(d) - k + inner + size], size) for d in own])
            h, first, inv = distinct(np.concatenate([window_hashes(d, k) for d in own]))
            mine = self._less(self.lookup("gram", k, h, core if core is None else core[first])[:, 0], k)[inv]
            h, first, inv = distinct(np.concatenate([window_hashes(d[:-1], k - 1) for d in own]))
            total, n1, n2, n3 = self.lookup("context", k, h, core if core is None else core[first], 4).T
            d = self.discount.get(k, [0, 0, 0])
            rest = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)
            total = total[inv]
            p = np.where(total > 0, mine / np.maximum(total, 1), 0.0) + rest[inv] * p
        return p, raw

    def _less(self, c: np.ndarray, k: int) -> np.ndarray:
        d = np.array([0.0, *self.discount.get(k, [0, 0, 0])])
        return np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0.0)


def fit(df: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """A model of all texts of df: counts of every n-gram, none pruned.

    N-grams are dealt out by their core, the words between the first and the last: then a shard has all that is to
    be known about the contexts and about the shorter n-grams of a core, and hardly anything but n-grams travels,
    once. A hot core's n-grams are dealt out one by one, and what its shards know is summed by hash afterwards. The
    number of shards follows the input's size. Each shard's sorted arrays are files of the shared folder; the driver
    gets a row of sums for each kind of them. A null text is an empty one; repeated rows count again; without rows
    every token is as likely as any. Single words and n-grams are compared by hashes of 64 bits, the words of n-grams
    by 48 of them: of 10**8 distinct words some twenty pairs may count as one there. Very long texts are cut nowhere:
    a task holds COUNTED tokens and one text more.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark, texts = df.sparkSession, df.select(by_name(text_col).cast("binary").alias("text"))
    n, folder = input_shards(df), scratch(spark, "kneser-ney")
    hot = hot_cores(texts, order, n)
    rows = counted(texts, order, n, hot)
    for level in range(order, 2, -1):
        for kind in ("core", "hash"):
            rows = stage(rows, kind, level, folder, n, order, hot)
    if order == 2:
        rows = stage(rows, "core", 2, folder, n, order, hot)
    rows = stage(rows, "words", 0, folder, n, order, hot)
    sums = [F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(7)]
    done, have = {}, set()
    for r in rows.where(F.col("kind").startswith("done-")).groupBy("kind", "level").agg(*sums).collect():
        key = (r["kind"].removeprefix("done-"), r["level"])
        have.add(key)
        if r["s0"] is not None:
            done[key] = list(r)[2:]
    return Model(folder, order, n, hot, have, done)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with n_tokens, n_known, train_tokens (long), base_score and score (double) for text_col.

    score is the log10 probability of a whole text with its end, base_score that of add-0.1 smoothed single words.
    Rows are scored one by one, repeats alike; a null text is an empty one; an empty table stays empty; other
    columns are passed on whatever their names, those called like the results are replaced. Very long texts are
    scored whole. Perplexity is 10 ** (-score / n_tokens).
    """
    results = "n_tokens n_known train_tokens base_score score".split()
    row, back = carried(df, {text_col, *results})
    df = df.select(row, by_name(text_col).cast("binary").alias("text"))
    N, V, order = model.train_tokens, model.distinct, model.order

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()

        def scored(rows: pa.RecordBatch, docs: list[np.ndarray]) -> pa.RecordBatch:
            p, raw = model.probabilities(docs)
            starts = np.concatenate([[0], np.cumsum([len(d) - order + 1 for d in docs])[:-1]])
            total = lambda x: np.add.reduceat(x, starts)
            base = total(np.log10((raw + 0.1) / (N + 0.1 * (V + 1))))
            cols = [np.array([len(d) - order + 1 for d in docs]), total((raw > 0).astype(np.int64)), np.full(len(docs), N), base, total(np.log10(p))]
            return pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, cols)], ["row", *results])

        for b in batches:
            docs, size, lo = [], 0, 0
            for i, t in enumerate(b.column(1).to_pylist()):
                docs.append(tokens(t, cache, order))
                size += len(docs[-1])
                if size >= SCORED:
                    yield scored(b.slice(lo, len(docs)), docs)
                    docs, size, lo = [], 0, i + 1
            if docs:
                yield scored(b.slice(lo, len(docs)), docs)

    schema = T.StructType([df.schema["row"]]).add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return df.mapInArrow(work, schema).select(*back, *results)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(fold("doc_id", 10) != 0))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
