"""Media columns: MPEG transport streams in a binary column.

A payload of 8-bit samples goes into one elementary stream: PES packets of up to
UNIT * UNITS_PER_PES bytes with a presentation time each, cut into transport packets
of 188 bytes after a program association and a program map table. Reading parses
both tables, checks the continuity counters, reassembles the PES packets, and gives
the time stamps and the random-access points.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.common import freed, text_or_empty

PACKET, SYNC = 188, 0x47
PROGRAM, PMT_PID, MEDIA_PID, STREAM_TYPE, STREAM_ID = 1, 0x1000, 0x0100, 0x06, 0xBD
UNIT, UNITS_PER_PES, CLOCK = 576, 64, 90_000
#: One unit stands for this much time: 576 samples at 48 kHz.
TICKS = CLOCK * UNIT // 48_000


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, most significant bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def table_packet(pid: int, data: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + data).ljust(PACKET, b"\xff")


PAT = table_packet(0, section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
PMT = table_packet(PMT_PID, section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000)))


def pes_header(n: int, pts: int) -> bytes:
    stamp = bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])
    return b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, n + 8, 0x84, 0x80, 5) + stamp


def clock_reference(ticks: int) -> list[int]:
    """The program clock in an adaptation field: 33 bits of 90 kHz, six reserved bits, nine of 27 MHz."""
    return [ticks >> 25 & 0xFF, ticks >> 17 & 0xFF, ticks >> 9 & 0xFF, ticks >> 1 & 0xFF, (ticks & 1) << 7 | 0x7E, 0]


def packets_of(pes: bytes, counter: int, clock: int = 0) -> np.ndarray:
    """The PES packet in transport packets; the first carries the clock and is a random-access point, the last is stuffed."""
    data = np.frombuffer(pes, np.uint8)
    first = PACKET - 12
    count = 1 + max(0, -(-(len(data) - first) // (PACKET - 4)))
    out = np.full((count, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
    out[:, 3] = 0x10 | (np.arange(counter, counter + count) & 15)
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5], out[0, 6:12] = 7, 0x50, clock_reference(clock)
    if count == 1:
        out[0, 4] += first - len(data)
        out[0, PACKET - len(data):] = data
        return out
    out[0, 12:] = data[:first]
    full = first + (count - 2) * (PACKET - 4)
    out[1:-1, 4:] = data[first:full].reshape(-1, PACKET - 4)
    tail = data[full:]
    if stuffed := PACKET - 4 - len(tail):
        out[-1, 3] |= 0x20
        out[-1, 4] = stuffed - 1
        if stuffed > 1:
            out[-1, 5] = 0
    out[-1, PACKET - len(tail):] = tail
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream with the whole payload; its time starts at 0."""
    out, counter, step = [PAT, PMT], 0, UNIT * UNITS_PER_PES
    for k, at in enumerate(range(0, len(payload), step)):
        part = payload[at:at + step]
        ticks = k * UNITS_PER_PES * TICKS
        packets = packets_of(pes_header(len(part), ticks) + part, counter, ticks)
        counter = counter + len(packets) & 15
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Demuxed:
    payload: bytes | None
    pts: list[int]
    random_access: list[int]  #: offsets of transport packets in bytes
    continuity_errors: int
    error: str | None = None  #: why the stream can't be read; the other fields are then empty or null


def demux_or_error(stream: bytes) -> Demuxed:
    """demux, where a damaged stream has no payload and says why."""
    try:
        return demux(stream)
    except ValueError as e:
        return Demuxed(None, [], [], 0, str(e))


def section_of(packets: np.ndarray, pids: np.ndarray, pid: int) -> bytes:
    """The section that begins in the first starting packet of the pid and ends in it."""
    found = np.flatnonzero((pids == pid) & (packets[:, 1] & 0x40 != 0))
    if not len(found):
        raise ValueError("a program table is missing")
    raw = packets[found[0]].tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at] if at < PACKET else 0
    if at + 3 > PACKET:
        raise ValueError("a program table is cut short")
    length = (raw[at + 1] << 8 | raw[at + 2]) & 0x0FFF
    data = raw[at:at + 3 + length]
    if len(data) < 16 or len(data) < 3 + length or crc32_mpeg(data) != 0:
        raise ValueError("a program table fails its CRC")
    return data


def demux(stream: bytes) -> Demuxed:
    """Parse the tables, then reassemble the first elementary stream of the first program.

    ValueError where the stream can't be read as one: packets cut short, no sync
    bytes, tables missing or failing their CRC, elementary packets without their head or end.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if not len(packets):
        return Demuxed(b"", [], [], 0)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("sync byte missing")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    starts = packets[:, 1] & 0x40 != 0
    pat = section_of(packets, pids, 0)
    pmt = section_of(packets, pids, struct.unpack(">H", pat[10:12])[0] & 0x1FFF)
    info = struct.unpack(">H", pmt[10:12])[0] & 0x0FFF
    if len(pmt) < 21 + info:
        raise ValueError("a program has no elementary stream")
    pid = struct.unpack(">H", pmt[13 + info:15 + info])[0] & 0x1FFF
    own = np.flatnonzero(pids == pid)
    media = packets[own]
    counters = media[:, 3] & 15
    errors = int(((counters[1:] - counters[:-1]) & 15 != 1).sum())
    adapted = media[:, 3] & 0x20 != 0
    begin = np.where(adapted, 5 + media[:, 4].astype(np.int32), 4)
    if (begin > PACKET).any():
        raise ValueError("an adaptation field is too long")
    random = adapted & (media[:, 4] > 0) & (media[:, 5] & 0x40 != 0)
    data = media[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    heads = (ends - (PACKET - begin))[starts[own]].tolist()
    parts, pts = [], []
    for a, b in zip(heads, [*heads[1:], len(data)]):
        if data[a:a + 3] != b"\0\0\1" or b - a < 9 or (data[a + 7] & 0x80 and b - a < 14):
            raise ValueError("PES start code missing")
        length, head = struct.unpack(">H", data[a + 4:a + 6])[0], data[a + 8]
        if data[a + 7] & 0x80:
            t = data[a + 9:a + 14]
            pts.append((t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1)
        if a + 6 + length > b:
            raise ValueError("PES packet cut short")
        parts.append(data[a + 9 + head:a + 6 + length])
    return Demuxed(b"".join(parts), pts, (own[random] * PACKET).tolist(), errors)


def padded(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


FEATURES = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("pts", T.ArrayType(T.LongType())), T.StructField("random_access", T.ArrayType(T.LongType())), T.StructField("continuity_errors", T.LongType()), T.StructField("error", T.StringType())])
_FEATURES = pa.struct([("payload", pa.binary()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())), ("continuity_errors", pa.int64()), ("error", pa.string())])


def store_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add the binary column out: the text's UTF-8 bytes, padded, as a transport stream.

    A null or empty text is stored as one unit of bytes 255, a text of any length
    whole; repeated rows get equal streams. An existing column of the name out is
    replaced, all others pass through. An empty df gives no rows.
    """

    @F.arrow_udf(T.BinaryType())
    def store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in freed(batches):
            yield pa.array([mux(padded((t.as_py() or "").encode())) for t in texts], pa.binary())

    return df.withColumn(out, store(text_or_empty(text)))


def read_media(df: DataFrame, media: str = "media", out: str = "read") -> DataFrame:
    """Add the struct column out from a column of transport streams: payload, time
    stamps, byte offsets of random-access points, and breaks of the counters.

    A null stream counts as empty and gives an empty payload. A damaged one gives a
    null payload, no stamps or points, and what is wrong in error; the rows beside it
    are read as ever. A break of the counters alone isn't damage. An existing column
    of the name out is replaced. An empty df gives no rows.
    """

    @F.arrow_udf(FEATURES)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for streams in freed(batches):
            yield pa.array([demux_or_error(s.as_py() or b"").__dict__ for s in streams], _FEATURES)

    return df.withColumn(out, read(F.col(media)))
