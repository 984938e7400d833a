"""MPEG transport streams as a media column.

``mux`` stores a payload losslessly: a program association table, a program map table, then the
payload in packetised elementary stream (PES) packets of at most ``PES_BYTES`` bytes, each with a
presentation timestamp, all in 188-byte transport packets with continuity counters; a PES packet
opens with a random-access indicator. ``demux`` works from the stored bytes alone: it reassembles
and parses the tables and checks their CRCs, checks the continuity counter of every packet (one
repetition of a packet is dropped, a signalled discontinuity is no gap), reassembles the PES packets
and lists timestamps with the random-access points where decoding can begin. ``store`` writes the
media column to files in the shared folder; ``read_media`` reads those.

Defined results: null text is the empty text, whose payload is 64 zero bytes; equal texts give
equal streams; repeated rows and rows with null doc_id are kept; extra columns are left out; no rows
give none; a null stream reads as nulls; a damaged stream reads as nulls with its ``error``.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skald.llm.shared import materialize, text_slices, whole_text

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID = 0x1000, 0x0100
PRIVATE_PES, STREAM_ID = 0x06, 0xBD
#: The clock's PID of a program that carries no clock.
NO_CLOCK = 0x1FFF
PES_BYTES = 8192
#: Ticks of the 90 kHz clock that one PES packet stands for.
TICKS = 3600
UNIT = 64


@functools.cache
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for byte in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _crc_table()[c >> 24 ^ byte]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    section = bytes([table_id, 0xB0, len(body) + 9, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return section + crc32_mpeg(section).to_bytes(4, "big")


@functools.cache
def _tables() -> bytes:
    """The two table packets with which every stream begins."""
    pat = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(2, 1, bytes([0xE0 | NO_CLOCK >> 8, NO_CLOCK & 255, 0xF0, 0, PRIVATE_PES, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
    packets = [bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + s for pid, s in ((0, pat), (PMT_PID, pmt))]
    return b"".join(p.ljust(PACKET, b"\xff") for p in packets)


def _pes(data: bytes, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 255, 0x01 | pts << 1 & 0xFE])
    return b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + data


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        pes = _pes(payload[at : at + PES_BYTES], (k * TICKS) % (1 << 33))
        # The first packet has an adaptation field for its random-access indicator, the last one stuffing.
        first, rest = pes[:182], pes[182:]
        whole, tail = divmod(len(rest), 184)
        count = 1 + whole + bool(tail)
        stuffing = 182 - len(first)
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15, 1 + stuffing, 0x40]) + b"\xff" * stuffing + first)
        if whole:
            body = np.empty((whole, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            body[:, 3] = 0x10 | (np.arange(1, whole + 1) + counter) & 15
            body[:, 4:] = np.frombuffer(rest, np.uint8, whole * 184).reshape(whole, 184)
            out.append(body.tobytes())
        if tail:
            field = 183 - tail  # the length byte is outside the field
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | (counter + count - 1) & 15, field]) + (b"\0" + b"\xff" * (field - 1) if field else b"") + rest[-tail:])
        counter += count
    return b"".join(out)


def _table_body(packets: np.ndarray, pid: np.ndarray, number: int, table_id: int) -> bytes:
    """The body of the first section of PID ``number``, which may go on over several packets."""
    data, begun = b"", False
    for at in np.flatnonzero(pid == number).tolist():
        packet = packets[at].tobytes()
        if not packet[3] & 0x10:
            continue
        part = packet[5 + packet[4] if packet[3] & 0x20 else 4 :]
        if packet[1] & 0x40:
            if begun:
                part = part[1 : 1 + part[0]]  # what is left of the section before the next one
            else:
                part, begun = part[1 + part[0] :], True
        if begun:
            data += part
        if len(data) >= 3 and len(data) >= 3 + (size := (data[1] & 15) << 8 | data[2]):
            section = data[: 3 + size]
            if section[0] != table_id or size < 9 or crc32_mpeg(section):
                break
            return section[8:-4]
    raise ValueError("a program table is missing or damaged")


def demux(stream: bytes) -> dict:
    """What the stored bytes hold: ``payload``, program and stream numbers, counters, timestamps."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole transport packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet has no sync byte")
    pid = (packets[:, 1] & 31).astype(np.int64) << 8 | packets[:, 2]
    pat = _table_body(packets, pid, 0, 0)
    while len(pat) > 4 and not pat[0] << 8 | pat[1]:
        pat = pat[4:]  # program 0 is the network's
    program, pmt_pid = pat[0] << 8 | pat[1], (pat[2] & 31) << 8 | pat[3]
    pmt = _table_body(packets, pid, pmt_pid, 2)
    pmt = pmt[4 + ((pmt[2] & 15) << 8 | pmt[3]) :]  # after the program's descriptors
    if len(pmt) < 5:
        raise ValueError("the program has no stream")
    kind, data_pid = pmt[0], (pmt[1] & 31) << 8 | pmt[2]
    rows = packets[pid == data_pid]
    rows = rows[rows[:, 3] >> 4 & 1 == 1]
    counters = (rows[:, 3] & 15).astype(np.int64)
    step = np.diff(counters) & 15
    again = np.r_[False, (step == 0) & (rows[1:] == rows[:-1]).all(1)]
    rows, step = rows[~again], step[~again[1:]]
    signalled = (rows[1:, 3] >> 5 & 1 == 1) & (rows[1:, 4] > 0) & (rows[1:, 5] >> 7 == 1)
    gaps = int(((step != 1) & ~signalled).sum())
    adapted = rows[:, 3] >> 5 & 1 == 1
    begin = np.where(adapted, 5 + rows[:, 4].astype(np.int64), 4)
    opens = rows[:, 1] >> 6 & 1 == 1
    access = adapted & (rows[:, 4] > 0) & (rows[:, 5] >> 6 & 1 == 1)
    if gaps or not len(rows) or not opens[0]:
        raise ValueError("packets are missing")
    held = np.arange(PACKET) >= begin[:, None]
    sizes = held.sum(1)
    elementary = rows[held].tobytes()
    edges = (np.cumsum(sizes) - sizes)[opens].tolist() + [len(elementary)]
    parts, stamps = [], []
    for a, b in zip(edges, edges[1:], strict=False):
        pes = elementary[a:b]
        size = pes[4] << 8 | pes[5]
        if pes[:3] != b"\0\0\1" or len(pes) != size + 6 or len(pes) < 14:
            raise ValueError("a PES packet is damaged")
        stamps.append((pes[9] & 0x0E) << 29 | pes[10] << 22 | (pes[11] & 0xFE) << 14 | pes[12] << 7 | pes[13] >> 1)
        parts.append(pes[9 + pes[8] :])
    return {"payload": b"".join(parts), "program": program, "stream_type": kind, "pid": data_pid, "packets": len(packets), "continuity_errors": gaps, "pts": stamps, "access_points": np.flatnonzero(access[opens]).tolist()}


def feature(found: dict, samples: np.ndarray) -> str:
    """Stream and sample features as one string: exact integers only."""
    values = samples.astype(np.int64)
    moves = int(np.abs(np.diff(values)).sum())
    return f"program={found['program']};type={found['stream_type']};packets={found['packets']};pes={len(found['pts'])};access={len(found['access_points'])};gaps={found['continuity_errors']};last_pts={found['pts'][-1]};sum={values.sum()};energy={(values * values).sum()};moves={moves}"


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: the UTF-8 bytes of the whole text, padded to a multiple of 64, as a transport stream."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, budget=4_000_000):
            raw = [t.encode() for t in texts]
            media = [mux(r + b"\0" * (-len(r) % UNIT or (0 if r else UNIT))) for r in raw]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return whole_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store(docs: DataFrame) -> DataFrame:
    """``to_media`` written to the shared folder, as read from there."""
    return materialize(to_media(docs), codec="zstd")


def read_media(stored: DataFrame) -> DataFrame:
    """Digests, timestamps and random-access points read back from the ``media`` column, and what is wrong with it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("access_points", pa.list_(pa.int64())), ("error", pa.string())])

    def row(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 9
        size, digest = len(media), hashlib.sha256(media).hexdigest()
        try:
            found = demux(media)
        except ValueError as e:
            return (None, None, None, size, digest, None, None, None, str(e))
        payload = found["payload"]
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size, digest, feature(found, np.frombuffer(payload, np.uint8)), found["pts"], found["access_points"], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                columns = list(zip(*map(row, part.column("media").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, access_points array<long>, error string")
