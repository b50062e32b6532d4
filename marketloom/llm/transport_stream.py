"""MPEG transport streams: store bytes as private-data PES packets, read them back, describe the stream.

The public layout (ISO/IEC 13818-1): packets of 188 bytes; a program association table on PID 0, a
program map table, and one elementary stream whose access units carry presentation timestamps; every
RAP_EVERY-th unit is marked as a random-access point and preceded by the tables.
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

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0, 0x1000, 0x100, 1, 0x06
UNIT, TICKS, RAP_EVERY = 16_384, 3_600, 8  # bytes of an access unit, 90 kHz ticks from one to the next, units from one random-access point to the next
BLOCK = 64
MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>, clocks array<long>"


@lru_cache(1)
def _crc_table() -> tuple[int, ...]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return tuple(table)


@lru_cache(256)
def crc32_mpeg(data: bytes) -> int:
    """The sections' checksum; 0 over a section with its own checksum."""
    table, c = _crc_table(), 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ x]
    return c


@lru_cache(8)
def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return b"\x00" + head + crc32_mpeg(head).to_bytes(4, "big")


def _tables() -> tuple[bytes, bytes]:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    return pat, pmt


def _psi_packet(pid: int, section: bytes, count: int) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | count & 15]) + section).ljust(PACKET, b"\xff")


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E]) + ((pts >> 14) & 0xFFFE | 1).to_bytes(2, "big") + ((pts << 1) & 0xFFFE | 1).to_bytes(2, "big")


def _clock_bytes(base: int) -> bytes:
    """A program clock reference of 90 kHz ticks, extension 0."""
    return (base << 15 | 0x3F << 9).to_bytes(6, "big")


def _unit_packets(unit: bytes, pts: int, rap: bool, count: int) -> bytes:
    """One access unit as transport packets; count is the first continuity counter. A random-access point carries the clock."""
    pes = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + unit
    head = 8 if rap else 0  # an adaptation field: its length, its flags, the clock
    n = 1 + -(-max(0, len(pes) - (184 - head)) // 184)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (count + np.arange(n)) & 15
    room = np.full(n, 184)
    room[0] -= head
    if rap:
        out[0, 3] |= 0x20
        out[0, 4:6] = head - 1, 0x50
        out[0, 6:12] = np.frombuffer(_clock_bytes(pts), np.uint8)
    spare = int(room.sum()) - len(pes)
    if spare:  # stuffing goes into the last packet's adaptation field
        before = head if n == 1 else 0
        out[-1, 3] |= 0x20
        out[-1, 4] = before + spare - 1
        if not before and spare > 1:
            out[-1, 5] = 0
        room[-1] -= spare
    out[np.arange(PACKET) >= (PACKET - room)[:, None]] = np.frombuffer(pes, np.uint8)
    return out.tobytes()


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """payload as a transport stream; an empty payload gives one empty access unit."""
    (pat, pmt), out, tables, count = _tables(), [], 0, 0
    for i, at in enumerate(range(0, max(1, len(payload)), unit)):
        if rap := i % RAP_EVERY == 0:
            out += [_psi_packet(PAT_PID, pat, tables), _psi_packet(PMT_PID, pmt, tables)]
            tables += 1
        packets = _unit_packets(payload[at : at + unit], i * TICKS, rap, count)
        count += len(packets) // PACKET
        out.append(packets)
    return b"".join(out)


def _read_section(payload: bytes) -> bytes:
    start = 1 + payload[0]
    length = int.from_bytes(payload[start + 1 : start + 3], "big") & 0xFFF
    section = payload[start : start + 3 + length]
    if crc32_mpeg(section):
        raise ValueError("a program table's checksum doesn't hold")
    return section[8:-4]


def demux(stream: bytes) -> dict:
    """Read a transport stream back: its programs, continuity errors and elementary streams.

    {"programs": {number: {"pmt_pid", "streams": {pid: type}}}, "packets", "continuity_errors", "length_errors", "clocks",
    "streams": {pid: [{"pts", "random_access", "data"}]}}. A packet with the counter of the one before is a
    repeat, and dropped, only if its bytes are the same; any other gap in a PID's counters counts as one error. Whole turns
    of the counter don't show in it: a unit whose bytes are not as many as its length field says counts as
    a length error. clocks: the references in order. Raises ValueError on lost sync or a bad table.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    start, control, count = (p[:, 1] & 0x40) > 0, p[:, 3] >> 4 & 3, (p[:, 3] & 15).astype(np.int16)
    field = (control & 2) > 0
    begin = np.where(field, 5 + p[:, 4].astype(np.int32), 4)
    begin[(control & 1) == 0] = PACKET
    access = field & (p[:, 4] > 0) & ((p[:, 5] & 0x40) > 0)
    out: dict = {"programs": {}, "packets": len(p), "continuity_errors": 0, "length_errors": 0, "streams": {}}
    ticking = np.flatnonzero(field & (p[:, 4] >= 7) & ((p[:, 5] & 0x10) > 0))
    out["clocks"] = [int.from_bytes(p[i, 6:12].tobytes(), "big") >> 15 for i in ticking]
    keep = {}
    for which in np.unique(pid):
        rows = np.flatnonzero((pid == which) & (begin < PACKET))
        step = (count[rows[1:]] - count[rows[:-1]]) & 15
        again = (step == 0) & (p[rows[1:]] == p[rows[:-1]]).all(axis=1)
        out["continuity_errors"] += int(((step != 1) & ~again).sum())
        again = np.concatenate([[False], again])
        keep[int(which)] = rows[~again]
    tables = {PAT_PID: None}
    for i in keep.get(PAT_PID, ()):
        body = _read_section(p[i, begin[i] :].tobytes())
        for k in range(0, len(body), 4):
            number, pmt = int.from_bytes(body[k : k + 2], "big"), int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF
            if number:
                tables[pmt] = number
    for pmt, number in tables.items():
        for i in keep.get(pmt, ()) if number else ():
            body = _read_section(p[i, begin[i] :].tobytes())
            at, streams = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF), {}
            while at < len(body):
                streams[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
            out["programs"][number] = {"pmt_pid": pmt, "streams": streams}
    for program in out["programs"].values():
        for es in program["streams"]:
            rows, units = keep.get(es, np.array([], int)), []
            heads = np.flatnonzero(start[rows])
            for a, b in zip(heads, [*heads[1:], len(rows)]):
                own = rows[a:b]
                pes = p[own][np.arange(PACKET) >= begin[own, None]].tobytes()
                length = int.from_bytes(pes[4:6], "big")
                out["length_errors"] += bool(length) and len(pes) != 6 + length
                t, skip, pts = pes[9:14], 9 + pes[8], None
                if pes[7] & 0x80:
                    pts = (t[0] & 0x0E) << 29 | (t[1] << 8 | t[2] & 0xFE) << 14 | (t[3] << 8 | t[4]) >> 1
                units.append({"pts": pts, "random_access": bool(access[own[0]]), "data": pes[skip : 6 + length] if length else pes[skip:]})
            out["streams"][es] = units
    return out


def describe(parsed: dict) -> str:
    """A short text of what the parser found."""
    units = parsed["streams"].get(ES_PID, [])
    sizes = [len(u["data"]) for u in units]
    return (
        f"programs={len(parsed['programs'])};packets={parsed['packets']};cc_errors={parsed['continuity_errors']};length_errors={parsed['length_errors']};clocks={len(parsed['clocks'])};units={len(units)};"
        f"rap={sum(u['random_access'] for u in units)};pts={units[0]['pts'] if units else ''}-{units[-1]['pts'] if units else ''};unit_max={max(sizes, default=0)}"
    )


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """data with zero bytes up to a positive multiple of block."""
    return data + bytes(-len(data) % block if data else block)


def _media_row(text: str | None) -> tuple:
    raw = (text or "").encode()
    media = mux(padded(raw))
    parsed = demux(media)
    units = parsed["streams"][ES_PID]
    payload = b"".join(u["data"] for u in units)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), describe(parsed), [u["pts"] for u in units], [u["pts"] for u in units if u["random_access"]], parsed["clocks"]


def media_digest(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Each text as a stored stream, read back: the columns of MEDIA_SCHEMA.

    timestamps are those of the access units, random_access those of the units that reading can begin at, clocks
    the clock references. A null text counts as empty and is stored as one block of zeros; equal texts give equal values;
    repeated rows stay; an empty table gives no rows. No shuffle: each batch of rows stands alone.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_media_row(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found)) or [()] * 10
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[f.split()[0] for f in MEDIA_SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, MEDIA_SCHEMA)
