"""Media columns: bytes in MPEG transport streams (ISO/IEC 13818-1)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_name, carried

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
PRIVATE_PES, PRIVATE_STREAM_1 = 0x06, 0xBD
CLOCK = 90_000

#: Payload bytes of an access unit, ticks between two, access units between two random-access points.
UNIT, TICKS, GOP = 16_384, 3_600, 4


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


PAT = section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, data: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0]) + data).ljust(PACKET, b"\xff")


def stamp(marker: int, ticks: int) -> bytes:
    """33 bits of a PTS in five bytes."""
    t = ticks & (1 << 33) - 1
    return bytes([marker << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """A transport stream with one program and one private stream: a PES packet with a PTS for each access unit.

    Tables come before each random-access point; its first packet has the random-access indicator and a clock
    reference. The last packet of a PES packet is filled up by its adaptation field.
    """
    out, counter = [], 0
    for n, lo in enumerate(range(0, len(payload), UNIT)):
        if n % GOP == 0:
            out += [_table_packet(PAT_PID, PAT, n // GOP), _table_packet(PMT_PID, PMT, n // GOP)]
        unit = payload[lo : lo + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(2, n * TICKS) + unit
        clock = n * TICKS
        first = bytes([0x50 if n % GOP == 0 else 0x10, clock >> 25 & 0xFF, clock >> 17 & 0xFF, clock >> 9 & 0xFF, clock >> 1 & 0xFF, (clock & 1) << 7 | 0x7E, 0])
        rest = len(pes) - (PACKET - 12)  # after the first packet
        full, tail = divmod(max(0, rest), PACKET - 4)
        k = 1 + full + (tail > 0)
        p = np.full((k, PACKET), 0xFF, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        p[:, 3] = 0x10 | (counter + np.arange(k)) & 15
        p[0, 1] |= 0x40
        body = np.frombuffer(pes, np.uint8)
        take = min(len(pes), PACKET - 12)
        p[0, 3] |= 0x20
        p[0, 4] = PACKET - 5 - take
        p[0, 5:12] = np.frombuffer(first, np.uint8)
        p[0, PACKET - take :] = body[:take]
        if full:
            p[1 : 1 + full, 4:] = body[take : take + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if tail:
            p[-1, 3] |= 0x20
            p[-1, 4] = PACKET - 5 - tail
            if tail < PACKET - 5:
                p[-1, 5] = 0
            p[-1, PACKET - tail :] = body[-tail:]
        counter += k
        out.append(p.tobytes())
    return b"".join(out)


class Stream:
    """An elementary stream as demux() finds it: its PID and type, payload, pts (ticks or None) and sizes of its access
    units, random_access (unit numbers), continuity errors, repeated packets."""

    def __init__(self, pid: int, kind: int):
        self.pid, self.kind = pid, kind
        self.payload, self.pts, self.sizes, self.random_access, self.errors, self.repeats = b"", [], [], [], 0, 0


def _starts(packets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each packet's payload begins, its adaptation flags)."""
    adapted = packets[:, 3] & 0x20 > 0
    start = np.where(adapted, 5 + packets[:, 4].astype(np.int32), 4)
    return np.where(packets[:, 3] & 0x10 > 0, np.minimum(start, PACKET), PACKET), np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)


def _steps(s: Stream | None, packets: np.ndarray) -> np.ndarray:
    """Packets of one PID without repeats; a counter that does not step by one, unless a discontinuity is announced, is an error."""
    packets = packets[packets[:, 3] & 0x10 > 0]
    if not len(packets):
        return packets
    step = (packets[1:, 3] - packets[:-1, 3]) & 15
    same = np.append(False, (step == 0) & (packets[1:] == packets[:-1]).all(1))
    if s:
        announced = _starts(packets)[1][1:] & 0x80 > 0
        s.repeats, s.errors = int(same.sum()), int(((step != 1) & ~same[1:] & ~announced).sum())
    return packets[~same]


def sections(packets: np.ndarray, pid: int) -> list[bytes]:
    """Table sections of a PID, put together over as many packets as they take."""
    own = _steps(None, packets)
    starts, found, held = _starts(own)[0], [], None
    for p, lo in zip(own, starts.tolist(), strict=True):
        body = p[lo:].tobytes()
        if p[1] & 0x40:
            if not body:
                raise ValueError(f"table section of PID {pid} is damaged")
            before, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            held = (held or b"") + before
            pieces = [held, body] if held else [body]
        elif held is None:
            continue  # the rest of a section whose start is not here
        else:
            pieces = [held + body]
        for held in pieces:
            while len(held) >= 3 and held[0] != 0xFF:
                size = 3 + ((held[1] & 15) << 8 | held[2])
                if len(held) < size:
                    break
                if crc_mpeg(held[:size]):
                    raise ValueError(f"table section of PID {pid} is damaged")
                found.append(held[:size])
                held = held[size:]
            if held[:1] == b"\xff":
                held = b""
    if held:
        raise ValueError(f"table section of PID {pid} is damaged")
    return found


#: Streams whose PES packets have no header beyond their length: maps, padding, private streams of kind 2, control.
PLAIN = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))


def _elementary(s: Stream, packets: np.ndarray) -> None:
    own = _steps(s, packets)
    start, flags = _starts(own)
    body = own[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(PACKET - start)])
    first = np.flatnonzero(own[:, 1] & 0x40)
    cuts, parts = [*ends[first].tolist(), len(body)], []
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        size = int.from_bytes(body[lo + 4 : lo + 6], "big")
        if hi - lo < 6 or body[lo : lo + 3] != b"\x00\x00\x01" or size > hi - lo - 6:
            raise ValueError(f"elementary packet {n} of PID {s.pid} is damaged")
        end = lo + 6 + size if size else hi  # without a length the packet lasts to the next one
        if body[lo + 3] in PLAIN:
            s.pts.append(None)
            parts.append(body[lo + 6 : end])
        else:
            s.pts.append(unstamp(body[lo + 9 : lo + 14]) if body[lo + 7] & 0x80 else None)
            parts.append(body[lo + 9 + body[lo + 8] : end])
        if flags[first[n]] & 0x40:
            s.random_access.append(n)
    s.payload, s.sizes = b"".join(parts), [len(p) for p in parts]


def demux(data: bytes) -> list[Stream]:
    """Reads a transport stream through its tables: PAT, each program's PMT, then every elementary stream in their order.

    Continuity counters must step by one; an exact repeat of a packet is skipped, a gap counts as an error. A packet
    or table that is cut or damaged raises ValueError.
    """
    if len(data) % PACKET:
        raise ValueError("length is not a multiple of 188")
    packets = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if not len(packets):
        return []
    if (packets[:, 0] != SYNC).any():
        raise ValueError("sync byte missing")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pats = sections(packets[pids == PAT_PID], PAT_PID)
    if not pats:
        raise ValueError("no program association table")
    entries = [pat[i : i + 4] for pat in pats for i in range(8, len(pat) - 4, 4)]
    programs = dict.fromkeys(int.from_bytes(e[2:], "big") & 0x1FFF for e in entries if e[:2] != b"\0\0")
    streams: dict[int, Stream] = {}
    for program in programs:
        pmts = sections(packets[pids == program], program)
        if not pmts:
            raise ValueError("no program map table")
        for pmt in pmts:
            at = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
            while at < len(pmt) - 4:
                pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
                streams.setdefault(pid, Stream(pid, pmt[at]))
                at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0x0FFF)
    for pid, s in streams.items():
        _elementary(s, packets[pids == pid])
    return list(streams.values())


def unit_at(stream: Stream, ticks: int) -> int:
    """The random-access point from which to decode for a time."""
    return max((n for n in stream.random_access if stream.pts[n] is not None and stream.pts[n] <= ticks), default=0)


def padded(data: bytes | None) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    data = data or b""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy and 16 shares of the 8-bit samples, as text."""
    count = np.bincount(samples, minlength=256)
    share, value = count / len(samples), np.arange(256)
    mean = float(share @ value)
    some = share[share > 0]
    hist = "".join(f"{int(x):02x}" for x in np.floor(count.reshape(16, 16).sum(1) * 255 / len(samples)))
    return f"mean={mean:.4f};dev={float(np.sqrt(max(0.0, share @ (value - mean) ** 2))):.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};hist={hist}"


def to_media(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with n_bytes and media_col (binary, a transport stream) in place of the text's column.

    A text's UTF-8 bytes, zero-padded to a positive multiple of 64, are the payload; null is taken as empty. Other
    columns are passed on, whatever their names (n_bytes and media_col are replaced). A text, however long, is held
    by one task as one value, as Spark itself holds it.
    """
    row, back = carried(df, {text_col, "n_bytes", media_col})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["row", "n_bytes", "media"])

    rows = df.select(row, by_name(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(work, T.StructType([rows.schema["row"]]).add("n_bytes", "long").add("media", "binary"))
    return out.select(*back, "n_bytes", F.col("media").alias(media_col))


#: What read_media() adds, and the type of each column in Arrow's terms.
READ = {
    "payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("long", pa.int64()), "media_bytes": ("long", pa.int64()),
    "media_sha256": ("string", pa.string()), "feature": ("string", pa.string()), "n_units": ("integer", pa.int32()), "pts": ("array<long>", pa.list_(pa.int64())),
    "random_access": ("array<int>", pa.list_(pa.int32())), "continuity_errors": ("integer", pa.int32()), "error": ("string", pa.string()),
}


def found_in(media: bytes | None) -> tuple:
    """A value for each column of READ; a stream that can't be read has its size, its digest and what is wrong with it."""
    if media is None:
        return (None,) * len(READ)
    digest = hashlib.sha256(media).hexdigest()
    try:
        streams = demux(media)
    except ValueError as e:
        return (None, None, None, len(media), digest, None, None, None, None, None, str(e))
    payload = b"".join(s.payload for s in streams)
    units = sum(len(s.sizes) for s in streams)
    access, at = [], 0
    for s in streams:
        access += [at + n for n in s.random_access]
        at += len(s.sizes)
    feature = features(np.frombuffer(payload, np.uint8)) + f";units={units};access={len(access)}" if payload else None
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), digest, feature,
        units, [t for s in streams for t in s.pts], access, sum(s.errors for s in streams), None,
    )


#: Streams that a task holds as Python's own bytes at a time.
STREAMS = 64


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row and the columns of READ for batches of (row, media), STREAMS at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, STREAMS):
            part = b.slice(lo, STREAMS)
            got = zip(*(found_in(m.as_py()) for m in part.column(1)), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, t) in zip(got, READ.values(), strict=True))], ["row", *READ])


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with what its transport streams hold in place of media_col: digests, features, timestamps, access points.

    Elementary streams come one after the other in the tables' order. A null stream gives nulls; one that is cut or
    damaged gives its size, digest and an error, and no other row suffers. Repeats give equal rows, an empty table
    none. Other columns are passed on, whatever their names; those called like the results are replaced.
    """
    row, back = carried(df, {media_col, *READ})
    rows = df.select(row, by_name(media_col).alias("media"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, (kind, _) in READ.items()))])

    return rows.mapInArrow(_read, schema).select(*back, *READ)


def query(spark, sf_dir: str) -> DataFrame:
    return read_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
