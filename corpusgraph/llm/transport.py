"""Media columns: MPEG transport streams.

A payload is stored as one elementary stream (private data) of a program: program tables, then access units of at most
UNIT bytes in PES packets with presentation timestamps. Every RAP_EVERY-th unit is a random-access point: the tables are
repeated before it and its first packet says so. Reading parses the tables by their CRC, checks sync bytes and
continuity counters, reassembles the PES packets and gives the payload, its timestamps and its random-access points.

Null texts are empty; a payload is the text's UTF-8 with zero bytes up to a positive multiple of 64. Equal texts give
equal streams. Repeated rows each get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, materialize, read

PACKET, UNIT, RAP_EVERY = 188, 4096, 16
#: 90 kHz ticks of an access unit.
TICKS = 3003
PAT_PID, PMT_PID, DATA_PID, PRIVATE_DATA, STREAM_ID = 0, 0x100, 0x101, 6, 0xBD
PES_HEADER, FIRST_FIELD = 14, 8
WRAP = (1 << 33) - 1


class BadStream(ValueError):
    pass


@lru_cache(64)
def crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2) + number.to_bytes(2) + b"\xc1\0\0"
    return head + body + crc_mpeg(head + body).to_bytes(4)


@cache
def tables() -> np.ndarray:
    """The packets of the program association and program map tables, with counters 0."""
    pat = section(0, 1, (1).to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2))
    pmt = section(2, 1, (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\0")
    packets = [(b"\x47" + (0x4000 | pid).to_bytes(2) + b"\x10\0" + s).ljust(PACKET, b"\xff") for pid, s in ((PAT_PID, pat), (PMT_PID, pmt))]
    return np.frombuffer(b"".join(packets), np.uint8).reshape(2, PACKET)


@cache
def template(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The packets of a unit of n bytes (no counters, times or payload), and where its payload's bytes go."""
    pes = b"\0\0\1" + bytes([STREAM_ID]) + (PES_HEADER - 6 + n).to_bytes(2) + b"\x80\x80\x05" + bytes(5)
    packets, places, left = [], [], PES_HEADER + n
    while left:
        field = bytes([FIRST_FIELD - 1, 0x10]) + bytes(FIRST_FIELD - 2) if not packets else b""
        room = PACKET - 4 - len(field)
        if left < room:
            grow = room - left
            if field:
                field = bytes([field[0] + grow]) + field[1:] + b"\xff" * grow
            else:
                field = b"\0" if grow == 1 else bytes([grow - 1, 0]) + b"\xff" * (grow - 2)
        take = min(left, PACKET - 4 - len(field))
        head = b"\x47" + ((0 if packets else 0x4000) | DATA_PID).to_bytes(2) + (b"\x30" if field else b"\x10") + field
        at = len(packets) * PACKET + len(head)
        places.append(np.arange(at, at + take))
        packets.append(head + bytes(take))
        left -= take
    out = np.frombuffer(b"".join(packets), np.uint8).copy()
    where = np.concatenate(places)
    out[where[:PES_HEADER]] = np.frombuffer(pes, np.uint8)
    out.setflags(write=False)
    return out, where


def stamp(pts: np.ndarray) -> np.ndarray:
    """The five bytes of a presentation timestamp."""
    p = pts & WRAP
    return np.stack([0x21 | p >> 29 & 0x0E, p >> 22 & 0xFF, p >> 14 & 0xFE | 1, p >> 7 & 0xFF, p << 1 & 0xFE | 1], axis=-1).astype(np.uint8)


def units_of(data: np.ndarray, n: int, first: int, counter: int) -> np.ndarray:
    """The packets of the units of n bytes in data, of which `first` is the number and `counter` the packets before."""
    form, where = template(n)
    count, number = len(data) // n, first + np.arange(len(data) // n)
    out = np.repeat(form[None], count, axis=0)
    out[:, where[PES_HEADER:]] = data.reshape(count, n)
    out[:, where[PES_HEADER - 5 : PES_HEADER]] = stamp(number * TICKS)
    clock = number * TICKS & WRAP  # base of 33 bits, 6 reserved, extension of 9
    out[:, 5] |= np.where(number % RAP_EVERY == 0, 0x40, 0).astype(np.uint8)
    out[:, 6:12] = np.stack([clock >> 25 & 0xFF, clock >> 17 & 0xFF, clock >> 9 & 0xFF, clock >> 1 & 0xFF, (clock & 1) << 7 | 0x7E, clock * 0], axis=-1)
    packets = out.reshape(-1, PACKET)
    packets[:, 3] |= (counter + np.arange(len(packets)) & 15).astype(np.uint8)
    return packets


def mux(payload: bytes) -> bytes:
    """The transport stream that holds a payload."""
    data, out, counter = np.frombuffer(payload, np.uint8), [], 0
    step = UNIT * RAP_EVERY
    for group, at in enumerate(range(0, len(data), step)):
        head = tables().copy()
        head[:, 3] |= group & 15
        out.append(head)
        part = data[at : at + step]
        whole = len(part) // UNIT * UNIT
        for piece, n, first in ((part[:whole], UNIT, 0), (part[whole:], len(part) - whole, whole // UNIT)):
            if len(piece):
                packets = units_of(piece, n, group * RAP_EVERY + first, counter)
                counter += len(packets)
                out.append(packets)
    return np.concatenate(out).tobytes() if out else tables().tobytes()


class Stream(NamedTuple):
    payload: bytes
    pid: int
    kind: int
    packets: int
    pts: np.ndarray
    #: Numbers of the units that are random-access points, and of the packets that they begin in.
    rap: np.ndarray
    rap_packet: np.ndarray


def parsed(packets: np.ndarray, table_id: int) -> bytes:
    """The body of the section that packets of one PID all repeat."""
    if not len(packets) or (packets[:, 4:] != packets[0, 4:]).any():
        raise BadStream("a table is missing or changes")
    raw = packets[0].tobytes()
    s = raw[5 + raw[4] :]
    n = 3 + (int.from_bytes(s[1:3]) & 0xFFF)
    if s[0] != table_id or n > len(s) or crc_mpeg(s[:n]):
        raise BadStream("a table is damaged")
    return s[8 : n - 4]


def demux(data: bytes) -> Stream:
    if not data or len(data) % PACKET:
        raise BadStream("not whole packets")
    p = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any() or (p[:, 1] & 0x80).any():
        raise BadStream("a packet is damaged")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    pat = parsed(p[pid == PAT_PID], 0)
    pmt_pid = next((int.from_bytes(pat[i + 2 : i + 4]) & 0x1FFF for i in range(0, len(pat), 4) if pat[i : i + 2] != b"\0\0"), None)
    pmt = parsed(p[pid == pmt_pid], 2)
    skip = 4 + (int.from_bytes(pmt[2:4]) & 0xFFF)
    kind, own = pmt[skip], int.from_bytes(pmt[skip + 1 : skip + 3]) & 0x1FFF
    for x in (PAT_PID, pmt_pid, own):
        counters = (p[pid == x, 3] & 15).astype(np.int32)
        if ((np.diff(counters) - 1) % 16).any():
            raise BadStream(f"packets of PID {x} are missing or out of order")
    which = np.flatnonzero(pid == own)
    q = p[which]
    has_field = (q[:, 3] & 0x20) > 0
    begin = np.where(has_field, 5 + q[:, 4].astype(np.int32), 4)
    starts = (q[:, 1] & 0x40) > 0
    body = q[np.arange(PACKET) >= begin[:, None]]
    at = np.concatenate(([0], np.cumsum(PACKET - begin)))[:-1][starts]
    if not len(at):
        return Stream(b"", own, kind, len(p), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if (at + PES_HEADER > len(body)).any() or (body[at[:, None] + np.arange(4)] != (0, 0, 1, STREAM_ID)).any():
        raise BadStream("an elementary packet is damaged")
    length = (body[at + 4].astype(np.int64) << 8 | body[at + 5]) + 6
    if (np.diff(np.concatenate((at, [len(body)]))) != length).any():
        raise BadStream("an elementary packet is not whole")
    s = body[at[:, None] + np.arange(9, 14)].astype(np.int64)
    pts = (s[:, 0] >> 1 & 7) << 30 | s[:, 1] << 22 | s[:, 2] >> 1 << 15 | s[:, 3] << 7 | s[:, 4] >> 1
    keep = np.ones(len(body), bool)
    head = 9 + body[at + 8].astype(np.int64)
    if (head == head[0]).all():
        keep[(at[:, None] + np.arange(head[0])).ravel()] = False
    else:
        for a, n in zip(at, head, strict=True):
            keep[a : a + n] = False
    random = starts & has_field & (q[:, 4] > 0) & ((q[:, 5] & 0x40) > 0)
    return Stream(body[keep].tobytes(), own, kind, len(p), pts, np.flatnonzero(random[starts]), which[random])


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (the stream), pts and rap_packets (array<long>, where the units' timestamps and
    the random-access points are) of each text."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        media = [mux(padded(t)) for t in texts]
        streams = [demux(m) for m in media]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t or b"") for t in texts], "media": media, "pts": [s.pts for s in streams], "rap_packets": [s.rap_packet for s in streams]}

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary, pts array<long>, rap_packets array<long>")


def media_features(stored: DataFrame) -> DataFrame:
    """Describe stored streams (doc_id, n_bytes, media): what is parsed out of their bytes."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in batch.column("media").to_pylist():
            s = demux(media)
            feature = f"pid={s.pid} type={s.kind} packets={s.packets} units={len(s.pts)} pts={s.pts[0]}-{s.pts[-1]} rap={len(s.rap)} last_rap={s.rap_packet[-1]}"
            row = len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), **out}

    return map_slices(stored.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", column="media")


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stream in a table of media columns, written to the shared folder; the rows come from what is read there."""
    return media_features(materialize(media_column(read(spark, sf_dir, "documents"))))
