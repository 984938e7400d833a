"""Token-ID output in a static range asymmetric numeral system (rANS).

One shared frequency table, counted over all tokens of all documents, codes independent blocks
of whole documents. Inside a block ``LANES`` interleaved coders take turns; their states are
kept at checkpoints, so that a decoder starts at all checkpoints at once, and a checksum of the
ids guards the block. Blocks lie in ascending doc_id order in the rows of Parquet files under
``blocks``, which Spark writes to any store; the table, its scale, the format's version and a
checksum lie beside them under ``table``. ``read`` needs nothing but these files, and each row
(``part, first_token, n_tokens, doc_ids, lengths, payload``) can be decoded alone with the table.

Defined results: null or empty text has its end id alone; null doc_ids come first and equal
doc_ids in the order of their texts; no documents, no blocks; a document longer than a block
has a larger block of its own; extra columns are left out. A damaged block raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.llm.bpe import default_path, opened
from skald.llm.shared import drop, materialize, partitions, shared_dir, text_slices, whole_text

SCALE = 20
LANES = 2048
CHECKPOINT = 128
BLOCK = 1 << 19
_LOW = np.uint64(1) << np.uint64(31)
_HEAD = struct.Struct("<4sIIIII")  # magic, tokens, lanes, steps between checkpoints, checkpoints, crc32 of the ids


VERSION = 1
_TABLE = "version int, scale int, frequencies binary, crc32 long"


class Table:
    """Frequencies that add up to ``2**SCALE``, at least one for each id that occurs."""

    def __init__(self, counts: np.ndarray, scaled: bool = False) -> None:
        total = 1 << SCALE
        if scaled:  # as stored: the frequencies themselves
            self._set(counts.astype(np.int64))
            return
        seen = np.flatnonzero(counts)
        if len(seen) > total:
            raise ValueError("more ids than the scale has room for")
        freq = np.zeros(len(counts), np.int64)
        if len(seen):
            share = counts[seen] / counts[seen].sum() * (total - len(seen))
            freq[seen] = 1 + np.floor(share).astype(np.int64)
            freq[seen[np.argmax(counts[seen])]] += total - freq.sum()
        self._set(freq)

    def _set(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.common = int(freq.argmax()) if len(freq) else 0
        self.packed = self.start << np.uint64(32) | self.freq
        self._symbols: np.ndarray | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """One row: at most ``2**SCALE`` frequencies of four bytes."""
        freq = self.freq.astype("<u4").tobytes()
        spark.createDataFrame([(VERSION, SCALE, bytearray(freq), zlib.crc32(freq))], _TABLE).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Table:
        row = spark.read.schema(_TABLE).parquet(path).first()
        if row is None or (row.version, row.scale) != (VERSION, SCALE) or zlib.crc32(row.frequencies) != row.crc32:
            raise ValueError("the frequency table is damaged or of another version")
        return cls(np.frombuffer(row.frequencies, "<u4"), scaled=True)

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))
        return self._symbols


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    steps = -(-len(ids) // lanes)
    padded = np.full(steps * lanes, table.common, np.int64)
    padded[: len(ids)] = ids
    packed = table.packed[padded].reshape(steps, lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    states: list[np.ndarray] = []
    sizes = np.zeros(steps + 1, np.int64)
    for t in range(steps - 1, -1, -1):
        freq = packed[t] & np.uint64(0xFFFFFFFF)
        out = np.flatnonzero(state >= freq << np.uint64(63 - SCALE))
        if len(out):
            full = state[out]
            words.append(full.astype(np.uint32))
            sizes[t] = len(out)
            state[out] = full >> np.uint64(32)
        quotient = state // freq
        state += quotient * (np.uint64(1 << SCALE) - freq)
        state += packed[t] >> np.uint64(32)
        if t % every == 0:
            states.append(state.copy())
    offsets = (np.cumsum(sizes) - sizes)[:steps:every].astype("<u4")
    head = _HEAD.pack(b"SKR1", len(ids), lanes, every, len(states), zlib.crc32(ids.astype("<u4").tobytes()))
    return b"".join([head, *(s.astype("<u8").tobytes() for s in reversed(states)), offsets.tobytes(), *(w.astype("<u4").tobytes() for w in reversed(words))])


def decode_block(payload: bytes, table: Table) -> np.ndarray:
    magic, n, lanes, every, points, crc = _HEAD.unpack_from(payload)
    if magic != b"SKR1":
        raise ValueError("not a block of this format")
    at = _HEAD.size
    state = np.frombuffer(payload, "<u8", points * lanes, at).reshape(points, lanes).copy()
    at += state.nbytes
    offset = np.frombuffer(payload, "<u4", points, at).astype(np.int64)
    words = np.frombuffer(payload, "<u4", offset=at + 4 * points).astype(np.uint64)
    steps = -(-n // lanes)
    out = np.zeros((points, every, lanes), np.uint32)
    symbols, mask = table.symbols, np.uint64((1 << SCALE) - 1)
    for t in range(every):
        live = points if (points - 1) * every + t < steps else points - 1
        if not live:
            break
        x = state[:live]
        slot = x & mask
        s = symbols[slot]
        out[:live, t] = s
        packed = table.packed[s]
        x = (packed & np.uint64(0xFFFFFFFF)) * (x >> np.uint64(SCALE)) + slot - (packed >> np.uint64(32))
        for k in range(live):
            low = np.flatnonzero(x[k] < _LOW)
            x[k, low] = x[k, low] << np.uint64(32) | words[offset[k] : offset[k] + len(low)]
            offset[k] += len(low)
        state[:live] = x
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return ids


def store_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Tokenise once: ``part, doc_id, first, ids`` in ascending doc_id order, each id two bytes where the vocabulary allows."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
    width = id_type(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, first, part = opened(path), 0, TaskContext.get().partitionId()
        end = np.array([end_id], width).tobytes()
        for rows, texts in text_slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(width).tobytes() + end for x in bpe.encode(texts)]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(width).itemsize
            starts = first + np.cumsum(n) - n
            first = int(starts[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), rows.column("doc_id"), pa.array(starts), pa.array(ids, pa.binary())], schema=schema)

    # Texts of one doc_id may be many: the beginning of the text deals them out in the same order.
    ordered = docs.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "part int, doc_id long, first long, ids binary"), codec="zstd")


def id_type(path: str, end_id: int) -> str:
    return "<u2" if max(opened(path).size, end_id + 1) <= 1 << 16 else "<u4"


def count_ids(stored: DataFrame, width: str) -> Table:
    """The shared table, counted over every document; as many rows as the vocabulary has come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                found = np.bincount(np.frombuffer(x, width))
                if len(found) > len(counts):
                    counts = np.pad(counts, (0, len(found) - len(counts)))
                counts[: len(found)] += found
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["id", "n"])

    found = stored.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    return Table(counts)


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, block: int = BLOCK) -> None:
    """Write the table, and the blocks of all documents in ascending doc_id order as Parquet rows, under ``out``."""
    path = path or default_path()
    width = id_type(path, end_id)
    stored = store_ids(whole_text(docs), path, end_id)
    table = count_ids(stored, width)
    schema = pa.schema([("part", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def blocks(rows: list[tuple]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(r[3] for r in rows), width)
        lengths = [len(r[3]) // np.dtype(width).itemsize for r in rows]
        row = {"part": [rows[0][0]], "first_token": [rows[0][2]], "n_tokens": [len(ids)], "doc_ids": [[r[1] for r in rows]], "lengths": [lengths], "payload": [encode_block(ids, table)]}
        return pa.RecordBatch.from_pydict(row, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (size >= block or row[0] != held[0][0]):
                    yield blocks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) // np.dtype(width).itemsize
        if held:
            yield blocks(held)

    stored.mapInArrow(run, "part int, first_token long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary").write.option("compression", "none").parquet(f"{out}/blocks")
    table.save(docs.sparkSession, f"{out}/table")
    drop(stored)


def read(spark: SparkSession, out: str, digest: bool = True) -> DataFrame:
    """Read the blocks back from the files alone: ``doc_id, start, n_tokens`` and ``ids_crc32``, or the ``ids`` themselves."""
    table, blocks = Table.load(spark, f"{out}/table"), spark.read.parquet(f"{out}/blocks")
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row per task that wrote
    before, base = 0, {}
    for part, n in totals:
        base[part], before = before, before + n
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["payload"], table).astype("<u4").tobytes()
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                parts = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                starts = ends - lengths + row["first_token"] + base[row["part"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts] if digest else parts, last[1])], schema=schema)

    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def write_and_read(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    out = shared_dir(spark)
    write(docs, out, path, end_id)
    return read(spark, out)
