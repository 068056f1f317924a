"""SentencePiece encoding and decoding: a Viterbi pass driven by an Aho-Corasick automaton over the pieces."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_name, carried

#: Vocabulary file of the query; a parameter everywhere else.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A larger file is not broadcast.
LARGEST = 64 << 20

SPACE = "▁"
#: Stands for a SPACE that is in the text itself: no text decoded from UTF-8 holds a surrogate.
LITERAL = "\udc00"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Chunks remembered by a worker, and the longest of them.
REMEMBERED, SHORT = 500_000, 64
#: Rows that are encoded or decoded at a time.
STEP = 512
IDS = T.ArrayType(T.IntegerType())
#: What a character outside all pieces costs below the lowest score, as the library has it.
UNKNOWN = 10.0


class _Known(dict):
    """The ids of chunks as bytes, remembered up to a bound."""

    def __init__(self, find: Callable[[str], array]):
        super().__init__()
        self.find = find

    def __missing__(self, chunk: str) -> bytes:
        ids = self.find(chunk).tobytes()
        if len(chunk) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


class Pieces:
    """The pieces of a model file, their scores and the automaton.

    A unigram model's scores are taken as they are. A BPE model has ranks in their place: its pieces get the log of
    Zipf's law over the ranks, so that the best path is that of a unigram model with these pieces. Bytes stand for
    characters outside all pieces, so decoding gives the text back exactly.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        if proto.trainer_spec.model_type != 1:
            order = sorted(normal, key=lambda x: (-x[2], x[0]))
            harmonic = math.log(sum(1 / r for r in range(1, len(order) + 1)))
            normal = [(i, p, -math.log(r) - harmonic) for r, (i, p, _) in enumerate(order, 1)]
        self.scores = {i: s for i, _, s in normal}
        self.bytes_at = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        if len(self.bytes_at) != 256:
            raise ValueError("the model has no byte pieces; decoding could not be exact")
        self.unknown = min(s for _, _, s in normal) - UNKNOWN
        self.prefix = SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        self.text = {i: p.replace(SPACE, " ").encode() for i, p, _ in normal} | {i: bytes([b]) for b, i in self.bytes_at.items()}
        self.single = {p for _, p, _ in normal if len(p) == 1}
        #: Pieces begin at most with spaces, so no piece crosses from one chunk into the next.
        self.by_chunk = not any(SPACE in p.lstrip(SPACE) for _, p, _ in normal)
        self.automaton = ahocorasick.Automaton()
        for i, p, s in normal:
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.known = _Known(self.viterbi)
        self.table: pa.Array | None = None

    def viterbi(self, s: str) -> array:
        """The best path through s in one pass: at each position the automaton's output links name the pieces that
        end there, and each relaxes the position's best score from where it begins."""
        n = len(s)
        best, step = [-math.inf] * n + [0.0], [None] * n  # by the position's last character; the start is the entry at -1
        if self.single.issuperset(s):
            for last, piece in self.automaton.iter(s):
                length, score, _ = piece
                new = best[last - length] + score
                if new > best[last]:
                    best[last], step[last] = new, piece
        else:
            self._with_odd(s, best, step)
        out, at = [], n
        while at:
            piece = step[at - 1]
            if piece:
                out.append(piece[2])
                at -= piece[0]
            else:
                at -= 1
                out.extend(self.bytes_at[b] for b in reversed((SPACE if s[at] == LITERAL else s[at]).encode()))
        return array("i", reversed(out))

    def _with_odd(self, s: str, best: list, step: list) -> None:
        """The pass of viterbi() where characters are outside all pieces; each is a step of its own, named None."""
        odd, done = [k for k, c in enumerate(s) if c not in self.single], 0
        for last, piece in self.automaton.iter(s):
            while done < len(odd) and odd[done] <= last:
                self._pass(best, step, odd[done])
                done += 1
            length, score, _ = piece
            new = best[last - length] + score
            if new > best[last]:
                best[last], step[last] = new, piece
        for k in odd[done:]:
            self._pass(best, step, k)

    def _pass(self, best: list, step: list, k: int) -> None:
        if best[k - 1] + self.unknown > best[k]:
            best[k], step[k] = best[k - 1] + self.unknown, None

    def encode(self, text: str, out: array) -> None:
        """Appends the ids of a text; an empty one has none."""
        if not text:
            return
        s = self.prefix + text.replace(SPACE, LITERAL).replace(" ", SPACE)
        if not self.by_chunk:
            out.extend(self.viterbi(s))
            return
        out.frombytes(b"".join(map(self.known.__getitem__, CHUNK.findall(s))))

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes of the text; ids outside the vocabulary raise KeyError."""
        b = b"".join([self.text[i] for i in ids])
        return b[1:] if self.prefix and b[:1] == b" " else b


    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """decode() of a column of ids, as strings; null for null."""
        if self.table is None:
            self.table = pa.array([self.text.get(i) for i in range(max(self.text) + 1)], pa.large_binary())
        flat = lists.flatten()
        if len(flat) and (flat.null_count or not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(self.table)):
            raise KeyError("an id outside the vocabulary")
        found = self.table.take(flat)
        if found.null_count:
            raise KeyError("an id outside the vocabulary")
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy()))
        at = np.frombuffer(found.buffers()[1], np.int64)[ends + found.offset] if len(flat) else np.zeros(len(ends), np.int64)
        data = np.frombuffer(found.buffers()[2] or b"", np.uint8)
        if self.prefix:
            starts = at[:-1][at[:-1] < at[1:]]
            drop = starts[data[starts] == 32]
            data, at = np.delete(data, drop), at - np.searchsorted(drop, at)
        texts = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(data)])
        return pc.if_else(lists.is_valid(), texts, None).cast(pa.large_string()).cast(pa.string())


_loaded: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def _model(df: DataFrame, path: str):
    model = open(path, "rb").read()
    if len(model) > LARGEST:
        raise ValueError(f"{path} has {len(model)} bytes; at most {LARGEST} are sent to the executors")
    return df.sparkSession.sparkContext.broadcast(model)


def _encoded(p: Pieces, column: pa.Array) -> pa.ListArray:
    """The ids of a column of texts."""
    ids, ends = array("i"), [0]
    texts = column.to_pylist()
    for t in texts:
        if t:
            p.encode(t, ids)
        ends.append(len(ids))
    none = pa.array([t is None for t in texts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()), mask=none)


def _mapped(df: DataFrame, col: str, path: str, out: dict[str, T.DataType], find: Callable[[Pieces, pa.Array], list[pa.Array]]) -> DataFrame:
    """df with the columns `out` (name: type) that find makes of col, STEP rows at a time, in place of those of that name."""
    row, back = carried(df, set(out))
    df, model = df.select(row, by_name(col).alias("given")), _model(df, path)
    names = [f"made{n}" for n in range(len(out))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(model.value)
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                yield pa.RecordBatch.from_arrays([part.column(0), *find(p, part.column(1))], ["row", *names])

    schema = T.StructType([df.schema["row"]])
    for n, kind in zip(names, out.values(), strict=True):
        schema = schema.add(n, kind)
    return df.mapInArrow(work, schema).select(*back, *[F.col(n).alias(c) for n, c in zip(names, out, strict=True)])


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """df with ids_col (array<int>) for text_col; null for null, empty for empty; texts are taken whole.

    Rows are encoded one by one: repeats get the same ids, an empty table stays empty. Other columns are passed on;
    one called like ids_col is replaced. A very long text without spaces is one pass over its length.
    """
    return _mapped(df, text_col, path, {ids_col: IDS}, lambda p, texts: [_encoded(p, texts)])


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str = MODEL) -> DataFrame:
    """df with text_col (string) for ids_col; null for null; other columns are passed on, whatever their names."""
    return _mapped(df, ids_col, path, {text_col: T.StringType()}, lambda p, ids: [p.decode_all(ids)])


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "ids", back_col: str = "decoded", path: str = MODEL) -> DataFrame:
    """decode(encode(df)) in one pass: a task has one Python worker in place of two, so the vocabulary and the remembered chunks once.

    back_col is decoded from the ids; it may be text_col, which it then replaces.
    """

    def both(p: Pieces, texts: pa.Array) -> list[pa.Array]:
        ids = _encoded(p, texts)
        return [ids, p.decode_all(ids)]

    return _mapped(df, text_col, path, {ids_col: IDS, back_col: T.StringType()}, both)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = round_trip(docs)
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))
