"""Media columns: MPEG transport streams.

A payload of 8-bit samples is stored as one elementary stream in a transport stream (ISO/IEC 13818-1): a programme
association table, a programme map table and packetised elementary packets with presentation timestamps, some of them
random-access points with a clock reference. Reading parses the programme tables (checking their CRC), checks each
PID's continuity counter, reassembles the packets and lists timestamps with the random-access points.

Null text counts as empty; every payload is padded to a positive multiple of 64 bytes; equal texts give equal values.
Repeated rows are stored as often as they occur, a null doc_id stays null, an empty table gives an empty one, and a text of any
length makes one stream, of about 1.04 times its bytes. Columns but doc_id and text are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import pieces

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PROGRAMME, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD  # private data in packetised elementary packets
BLOCK = 64
#: Samples of an access unit; at 8 kHz one lasts 1024 / 8000 s, on the 90 kHz clock 11520 ticks.
UNIT, RATE, CLOCK = 1024, 8000, 90_000
RANDOM_ACCESS_EVERY = 8
PTS_WRAP = 1 << 33


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


CRC = _crc_table()


@lru_cache(maxsize=1024)
def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def section(table_id: int, body: bytes, number: int) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _packet(pid: int, counter: int, body: bytes, start: bool, field: bytes = b"") -> bytes:
    """One packet; an adaptation field without its length byte goes in `field`, and stuffing fills what is left."""
    room = PACKET - 4 - len(body)
    head = bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF])
    if not room:
        return head + bytes([0x10 | counter]) + body
    if room == 1:
        return head + bytes([0x30 | counter, 0]) + body
    field = field or b"\x00"
    return head + bytes([0x30 | counter, room - 1]) + field + b"\xff" * (room - 1 - len(field)) + body


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = section(0x00, PROGRAMME.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"), 1)
    pmt = section(0x02, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00", PROGRAMME)
    return b"".join(_packet(pid, 0, (b"\x00" + s).ljust(PACKET - 4, b"\xff"), True) for pid, s in ((PAT_PID, pat), (PMT_PID, pmt)))


def _pts(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """Store the payload as a transport stream."""
    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        t = k * UNIT * CLOCK // RATE % PTS_WRAP
        unit = payload[at : at + UNIT]
        body = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts(t) + unit
        field = b""
        if k % RANDOM_ACCESS_EVERY == 0:
            field = b"\x50" + (t << 15 | 0x7E00).to_bytes(6, "big")  # random access and clock reference
        room = PACKET - 4 - (len(field) + 1 if field else 0)
        out.append(_packet(DATA_PID, counter, body[:room], True, field))
        counter = counter + 1 & 15
        for i in range(room, len(body), PACKET - 4):
            out.append(_packet(DATA_PID, counter, body[i : i + PACKET - 4], False))
            counter = counter + 1 & 15
    return b"".join(out)


def _section_of(body: bytes, table_id: int) -> bytes:
    s = body[1 + body[0] :]
    size = 3 + ((s[1] & 0x0F) << 8 | s[2])
    if s[0] != table_id or len(s) < size or crc32_mpeg(s[:size]):
        raise ValueError(f"table {table_id:#x} is broken")
    return s[8 : size - 4]


def demux(stream: bytes) -> dict:
    """Read a transport stream back: payload, timestamps, random-access flags, packets and continuity errors of the first elementary stream of the first programme."""
    if len(stream) % PACKET or not stream:
        raise ValueError("a transport stream is whole packets of 188 bytes")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("sync byte missing")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    start = (p[:, 1] & 0x40) > 0
    has_field, has_body = (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0
    offset = np.where(has_field, 5 + p[:, 4].astype(np.int32), 4)
    access = has_field & (p[:, 4] > 0) & ((p[:, 5] & 0x40) > 0)

    def table(of: int, table_id: int) -> bytes:
        at = int(np.flatnonzero((pid == of) & start)[0])
        return _section_of(stream[at * PACKET + int(offset[at]) : (at + 1) * PACKET], table_id)

    entries = table(PAT_PID, 0x00)
    pmt_pid = next((entries[i + 2] & 0x1F) << 8 | entries[i + 3] for i in range(0, len(entries), 4) if entries[i : i + 2] != b"\0\0")
    body = table(pmt_pid, 0x02)
    at = 4 + ((body[2] & 0x0F) << 8 | body[3])
    stream_type, data_pid = body[at], (body[at + 1] & 0x1F) << 8 | body[at + 2]

    own = np.flatnonzero((pid == data_pid) & has_body)
    counter = p[own, 3] & 15
    errors = int(((counter[:-1] + 1 & 15) != counter[1:]).sum())
    times, random_access, units = [], [], []
    first = np.flatnonzero(start[own])
    where, offs = own.tolist(), offset[own].tolist()
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(where)], strict=True):
        pes = b"".join(stream[where[i] * PACKET + offs[i] : (where[i] + 1) * PACKET] for i in range(a, b))
        if pes[:3] != b"\0\0\1":
            raise ValueError("an elementary packet has no start code")
        size = pes[4] << 8 | pes[5]
        t = pes[9:14]
        times.append((t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1)
        random_access.append(bool(access[where[a]]))
        units.append(pes[9 + pes[8] : 6 + size if size else None])
    return {"payload": b"".join(units), "pts": times, "random_access": random_access, "sizes": [len(u) for u in units], "packets": len(p), "errors": errors, "stream_type": stream_type, "pid": data_pid}


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b"\0" * (BLOCK - len(data) % BLOCK if len(data) % BLOCK or not data else 0), len(data)


def feature_of(read: dict) -> str:
    """What the stream shows: tables, packets, continuity, timestamps and random-access points, and the mean and spread of the samples."""
    s = np.frombuffer(read["payload"], np.uint8)
    total, squares = int(s.sum(dtype=np.int64)), int((s.astype(np.int64) ** 2).sum())
    return f"pid={read['pid']};type={read['stream_type']};packets={read['packets']};units={len(read['pts'])};cc_errors={read['errors']};pts={read['pts'][0]}-{read['pts'][-1]};random_access={sum(read['random_access'])};sum={total};squares={squares}"


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_units array<struct<pts: long, position: long, random_access: boolean>>"
INDEX = pa.list_(pa.struct([("pts", pa.int64()), ("position", pa.int64()), ("random_access", pa.bool_())]))


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Store each whole text as a transport stream, read the stored bytes back and describe them.

    access_units is the stream's index as read back: timestamp, byte position in the payload, and whether it is a random-access
    point. With `keep_media` a column more holds the stream itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for text in b.column("text").to_pylist():
                payload, n = payload_of(text)
                stored = mux(payload)
                read = demux(stored)
                back = read["payload"]
                row = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(read)]
                at = np.cumsum([0, *read["sizes"][:-1]]).tolist()
                row.append([{"pts": t, "position": i, "random_access": r} for t, i, r in zip(read["pts"], at, read["random_access"], strict=True)])
                rows.append([*row, stored] if keep_media else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), INDEX, pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_units", "media"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=names[: len(cols) + 1])

    more = ", media binary" if keep_media else ""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS + more)
