import hashlib
import random
import zlib

import pytest

from aidlake.llm import transport as ts


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 170, 176, 177, 352, 360, 16_000, 16_384, 16_385, 70_001, 400_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = ts.mux(ts.padded(data))
    (s,) = ts.demux(media)
    assert s.payload == ts.padded(data) and len(s.payload) % 64 == 0 and s.payload[:n] == data
    assert not s.errors and len(media) % 188 == 0
    assert s.pts == [i * ts.TICKS for i in range(len(s.sizes))]
    assert s.random_access == list(range(0, len(s.sizes), ts.GOP))


def test_every_tail_length():
    for n in range(1, 600):
        assert ts.demux(ts.mux(b"\x47" * n))[0].payload == b"\x47" * n


def test_seek_and_wrapped_clock():
    (s,) = ts.demux(ts.mux(bytes(10 * ts.UNIT)))
    assert ts.unit_at(s, 6 * ts.TICKS) == 4 and ts.unit_at(s, 0) == 0
    assert ts.unstamp(ts.stamp(2, (1 << 33) - 5)) == (1 << 33) - 5


def test_continuity_repeats_and_damage():
    media = ts.mux(b"x" * 5_000)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = b"".join(packets[:5] + packets[4:5] + packets[5:])
    assert ts.demux(twice)[0].payload == b"x" * 5_000 and ts.demux(twice)[0].repeats == 1
    with pytest.raises(ValueError):
        ts.demux(b"".join(packets[:6] + packets[7:]))  # the elementary packet is short
    with pytest.raises(ValueError):
        ts.demux(media[:-1])
    broken = bytearray(media)
    broken[10] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        ts.demux(bytes(broken))


def test_known_crc():
    assert ts.crc_mpeg(b"123456789") == 0x0376E6E7  # CRC-32/MPEG-2 check value


def test_columns(spark):
    rows = [(1, "héllo", 5, "m"), (2, None, 6, "m"), (3, "", 7, "m"), (3, "", 7, "m"), (None, "é" * 40_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, media string")
    out = ts.read_media(ts.to_media(df)).collect()
    assert len(out) == 5
    for r in out:
        text = {1: "héllo", 2: "", 3: "", None: "é" * 40_000}[r.doc_id].encode()
        p = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len({(r.media_sha256, r.feature) for r in out if r.doc_id in (2, 3)}) == 1
    assert ts.read_media(ts.to_media(df.limit(0))).collect() == []


def packet(pid, body, counter, start=False, flags=None):
    """A packet written by the standard's layout, filled up by its adaptation field."""
    room = 184 - len(body)
    if room == 0 and flags is None:
        head, fill = 0x10, b""
    elif room == 1:
        head, fill = 0x30, b"\x00"
    else:
        head, fill = 0x30, bytes([room - 1, flags or 0]) + b"\xff" * (room - 2)
    out = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, head | counter & 15]) + fill + body
    assert len(out) == 188
    return out


def pes(stream_id, data, pts=None, size=True):
    head = bytes([0x80, 0x80 if pts is not None else 0, 5 if pts is not None else 0]) + (ts.stamp(2, pts) if pts is not None else b"")
    return b"\x00\x00\x01" + bytes([stream_id]) + (len(head + data).to_bytes(2, "big") if size else b"\0\0") + head + data


def test_streams_that_others_write():
    """Two programs, a map table over two packets, video without a length, audio, padding, an announced discontinuity."""
    pat = ts.section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in ((0, 0x10), (1, 0x100), (2, 0x200))))
    entry = lambda kind, pid, extra=b"": bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(extra)).to_bytes(2, "big") + extra
    one = ts.section(2, 1, b"\xe1\x01\xf0\x02ab" + entry(0x1B, 0x101, b"\x52" * 200) + entry(0x0F, 0x102))
    two = ts.section(2, 2, b"\xe2\x01\xf0\x00" + entry(0x06, 0x201))
    whole = b"\x00" + one
    video = [pes(0xE0, bytes([65 + k]) * 300, k * 3600, size=False) for k in range(2)]
    audio, other = pes(0xC0, b"sound" * 10, 90_000), b"\x00\x00\x01\xbf\x00\x04data"
    out = [packet(0, b"\x00" + pat, 0, True), packet(0x100, whole[:184], 0, True), packet(0x100, whole[184:].ljust(184, b"\xff"), 1), packet(0x200, b"\x00" + two, 5, True)]
    out += [packet(0x101, video[0][:184], 3, True, None if len(video[0]) >= 184 else 0), packet(0x102, audio, 0, True), packet(0x101, video[0][184:], 4)]
    out += [packet(0x101, video[1][:180], 9, True, 0xC0), packet(0x201, other, 0, True), packet(0x101, video[1][180:], 10), packet(0x1FFF, b"\xff" * 184, 0)]
    v, a, o = ts.demux(b"".join(out))
    assert (v.pid, v.kind, v.payload, v.pts, v.random_access, v.errors) == (0x101, 0x1B, b"A" * 300 + b"B" * 300, [0, 3600], [1], 0)
    assert (a.pid, a.payload, a.pts) == (0x102, b"sound" * 10, [90_000]) and (o.pid, o.payload, o.pts) == (0x201, b"data", [None])
    out[7] = packet(0x101, video[1][:180], 9, True, 0x40)  # the same step, not announced
    assert ts.demux(b"".join(out))[0].errors == 1
    with pytest.raises(ValueError, match="damaged"):
        ts.demux(b"".join(out[:2] + out[3:]))  # half a table


def test_payload_by_the_packet_layout():
    """What mux() writes, read by plain byte arithmetic."""
    data, got = random.Random(3).randbytes(50_000), b""
    media = ts.mux(data)
    for i in range(0, len(media), 188):
        p = media[i : i + 188]
        if (p[1] & 31) << 8 | p[2] == ts.ES_PID:
            body = p[4:] if not p[3] & 32 else p[5 + p[4] :]
            got += body[14:] if p[1] & 64 else body  # start code, id, length, flags, stamp
    assert got == data


def test_damaged_and_null_streams_leave_the_others_alone(spark):
    good = ts.mux(b"g" * 64)
    rows = [(1, good, "f", "t"), (2, good[:100], "f", "t"), (3, None, None, None), (4, b"", "f", "t"), (5, bytes(188), "f", "t")]
    got = {r.doc_id: r for r in ts.read_media(spark.createDataFrame(rows, "doc_id long, media binary, feature string, `a.row` string")).collect()}
    assert got[1].payload_bytes == 64 and got[1].error is None and got[1]["a.row"] == "t" and got[1].feature != "f"
    assert "188" in got[2].error and got[2].media_bytes == 100 and got[2].payload_bytes is None
    assert set(got[3].asDict().values()) == {3, None} and got[4].payload_bytes == 0 and "sync" in got[5].error


def test_streams_are_read_few_at_a_time():
    import pyarrow as pa

    media = [ts.mux(ts.padded(b"x" * n)) for n in range(150)] + [None, b"bad"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(media))), pa.array(media, pa.binary())], ["row", "media"])
    got = list(ts._read(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in got) <= ts.STREAMS
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [(n, *ts.found_in(m)) for n, m in enumerate(media)]
