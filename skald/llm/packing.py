"""Vector best-fit packing of token sequences.

Every document's ids, with an end id, are cut into pieces of at most ``capacity`` tokens only
where they are longer. Pieces are dealt by a hash into groups of about ``group`` pieces, and each
group is packed on its own, largest pieces first: a bin has residual tokens, documents and
attention cost (the sum of squared lengths), a piece may only enter where it meets all three
constraints, and among those bins the weighted residual norm (best fit) or the weighted dot
product of need and residual decides. The default document and attention limits follow from the
token capacity: as few sequences as possible are asked for, and a smaller limit would cost some.
Their residuals still choose among bins that tokens alone leave equal or close; give smaller limits
to bind.

Defined results: null or empty text is a document of its end id alone; equal rows are packed
each; rows with null doc_id too; no rows, no pieces; extra columns are left out. Only lengths,
never texts, are shuffled; pieces are dealt by their place in a written table, so that equal rows
spread too and no task holds more than about ``group`` pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skald.llm.bpe import default_path, opened
from skald.llm.shared import materialize, text_slices, whole_text


#: Of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.1, 0.1)


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = opened(path), np.array([end_id], "<u4").tobytes()
        for rows, texts in text_slices(batches, budget=700_000):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(rows.column("doc_id").to_pylist(), bpe.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return whole_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int, most_docs: int, most_cost: int, weights: tuple[float, float, float] = WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (in decreasing order of length, as given)."""
    limits = np.array([capacity, most_docs, most_cost], float)
    w = np.array(weights)
    left = np.zeros((3, len(lengths)))  # residual tokens, documents and cost of each open bin
    full = np.zeros(len(lengths), np.int64)  # the bin behind each open one
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used, n = 0, 0
    smallest = lengths.min() if len(lengths) else 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], float)
        at = np.flatnonzero((left[0, :n] >= need[0]) & (left[1, :n] >= 1) & (left[2, :n] >= need[2]))
        if len(at):
            rest = left[:, at]
            if by == "norm":
                score = (((rest - need[:, None]) / limits[:, None]) ** 2 * w[:, None]).sum(0)
                j = at[score.argmin()]
            else:
                j = at[(rest / limits[:, None] * (w * need / limits)[:, None]).sum(0).argmax()]
        else:
            if length > capacity or length * length > most_cost or most_docs < 1:
                raise ValueError(f"a piece of {length} tokens meets no bin's limits")
            j, n = n, n + 1
            left[:, j], full[j], used = limits, used, used + 1
        bins[i], offsets[i] = full[j], capacity - left[0, j]
        left[:, j] -= need
        if left[0, j] < smallest or left[1, j] < 1 or left[2, j] < smallest * smallest:  # closed: the last open bin takes its place
            n -= 1
            left[:, j], full[j] = left[:, n], full[n]
    return bins, offsets


def pack(items: DataFrame, n_groups: int, capacity: int = 4096, most_docs: int | None = None, most_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, by: str = "norm") -> DataFrame:
    """``items``, a written table, with ``sequence_id`` and ``offset``; each of ``n_groups`` groups is packed by one task."""
    most_docs, most_cost = most_docs or capacity, most_cost or capacity * capacity

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, rows["offset"] = best_fit(rows["length"].to_numpy(), capacity, most_docs, most_cost, weights, by)
        rows["sequence_id"] = (np.int64(key[0]) << 32) + bins
        return rows.drop(columns="part")

    dealt = items.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))
    return dealt.groupBy("part").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 4096, group: int = 4096, **limits) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    items = materialize(pieces(docs, path, end_id, capacity))
    return pack(items, max(1, round(items.count() / group)), capacity, **limits).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
