"""Substring deduplication over a log-structured index of fingerprints.

A window is ``WINDOW`` consecutive words. In each window the smallest hash of its ``GRAM``-word
grams is its anchor: equal windows have equal anchors, so a window can only repeat where its
anchor's hash does, and neighbouring windows share an anchor. The index keeps one row for each
anchor hash and context (the words of all windows that the anchor stands for) with its count and
first place, in immutable runs sorted by both, one per batch; a manifest lists the runs, so that
another session can open the index and go on. Runs are compacted into one before a batch would
find more than ``most_runs`` of them.

A new batch's run is merge-joined with the older runs. A later occurrence of a whole context loses
all its windows at once; where contexts of one anchor differ (where a repeated passage begins or
ends) and one of them is new, the windows of their first occurrences are read from the texts again
and compared one by one. Rows that repeat nowhere never meet a text again, and of older documents
only those are read that hold such a first occurrence. Windows and contexts are known by 64 bits of
BLAKE2b of their words, salted anew for each index so that texts can't be written to collide, and
count as equal only within one anchor hash. That hash, of polynomials over letters and words, chooses
and groups; texts made to confuse it cost time, not words.

No group is gathered: counts and first occurrences are aggregates with map-side combination, written
before they are joined, so that skew handling can split the joins.

Defined results: words are runs of other bytes than 0x20 and 0x09-0x0D; null text has no words,
texts shorter than a window lose nothing; a word goes if a window that covers it also starts
earlier (smaller doc_id, null first; or same doc_id and earlier start), judged on the input;
rows with one doc_id count as one document's starts (and are gathered as one document is), so exact
repetitions of a whole row are both kept; no rows, no result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import secrets as random_bytes
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.llm.shared import drop, materialize, releasing, shared_dir, text_slices, whole_text

WINDOW, GRAM = 20, 5
#: Characters hashed at a time: their arrays take some 100 bytes a character.
SLICE = 300_000
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIXES = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base = int(_BASES[which])
        _POWERS[which] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
    return _POWERS[which]


def _mixed(x: np.ndarray, which: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIXES[which]
    return (x ^ x >> np.uint64(29)) * _MIXES[1 - which]


class Spans:
    """Hashes of any span of a sequence from its prefix sums."""

    def __init__(self, values: np.ndarray, which: int) -> None:
        self.which = which
        power, self.inverse = _powers(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin], self.which)


class Words:
    """The words of several texts: places in the joined bytes (one space between words), text numbers and hashes."""

    def __init__(self, texts: list[str], salt: bytes) -> None:
        self.salt = salt
        raw = [b" ".join(t.encode().split()) for t in texts]
        self.data = b"\n".join([b"", *raw, b""])
        codes = np.frombuffer(self.data, np.uint8)
        white = (codes == 32) | ((codes >= 9) & (codes <= 13))
        change = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.begin, self.end = change[::2], change[1::2]
        tops = 1 + np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        self.text = np.searchsorted(tops, self.begin, "right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))  # each text's first word
        letters = codes.astype(np.uint64) + np.uint64(1)
        spans = Spans(letters, 0)
        self.grams = Spans(spans(self.begin, self.end), 0)

    def names(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """What spans of words, up to ``last``, are known by: a digest of the words themselves."""
        data, salt, digest = self.data, self.salt, hashlib.blake2b
        made = b"".join([digest(data[a:b], digest_size=8, salt=salt).digest() for a, b in zip(self.begin[first].tolist(), self.end[last - 1].tolist(), strict=True)])
        return np.frombuffer(made, np.uint64)


def anchors_of(words: Words, named: bool = True) -> dict[str, np.ndarray]:
    """The anchors of all windows: text, first window's start, number of windows, hash and, if ``named``, context."""
    n, width = len(words.begin), WINDOW - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return {"text": none, "start": none, "count": none, "h": none, "ctx": none}
    at = np.arange(n - GRAM + 1)
    gram = words.grams(at, at + GRAM)
    best, reach = at, 1
    while reach < width:  # the leftmost smallest gram among ever more
        step = min(reach, width - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(gram[right] < gram[left], right, left)
        reach += step
    start = np.arange(n - WINDOW + 1)
    inside = words.text[start] == words.text[start + WINDOW - 1]
    start, anchor = start[inside], best[start[inside]]
    if not len(start):
        return {"text": none, "start": none, "count": none, "h": none, "ctx": none}
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)])
    count = np.diff(np.r_[new, len(start)])
    begin, anchor = start[new], anchor[new]
    ctx = words.names(begin, begin + count + WINDOW - 1) ^ _mixed((anchor - begin << 8 | count).astype(np.uint64), 0) if named else np.zeros(len(begin), np.uint64)
    text = words.text[begin]
    return {"text": text, "start": begin - words.first[text], "count": count, "h": gram[anchor].view(np.int64), "ctx": ctx.view(np.int64)}


def anchors(docs: DataFrame, salt: bytes) -> DataFrame:
    """``h, ctx, doc_id, span``: ``span`` is the first window's start times 32 plus the number of windows."""
    schema = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("span", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, budget=SLICE):
            found = anchors_of(Words(texts, salt))
            doc = rows.column("doc_id").take(pa.array(found["text"]))
            yield pa.RecordBatch.from_arrays([pa.array(found["h"]), pa.array(found["ctx"]), doc, pa.array(found["start"] * 32 + found["count"])], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "h long, ctx long, doc_id long, span long")


_PLACE = "struct<doc_id: bigint, span: bigint>"
_RUN = f"h long, ctx long, n long, first {_PLACE}"
_KEY = ["h", "ctx"]


class FingerprintIndex:
    """Sorted immutable runs of fingerprints under ``path``, and the manifest that lists them."""

    def __init__(self, spark: SparkSession, path: str, salt: bytes, runs: list[str], made: int, most_runs: int) -> None:
        self.spark, self.path, self.salt, self.runs, self.made, self.most_runs = spark, path, salt, runs, made, most_runs

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, most_runs: int = 2) -> FingerprintIndex:
        index = cls(spark, path or shared_dir(spark), random_bytes.token_bytes(16), [], 0, most_runs)
        index._commit()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, most_runs: int = 2) -> FingerprintIndex:
        """The index that any session has left under ``path``."""
        last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        return cls(spark, path, bytes(last.salt), list(last.runs), last.made, most_runs)

    def _commit(self) -> None:
        # A version counts once its row is there; runs that no version lists are of no effect.
        row = [(self.made, bytearray(self.salt), self.runs, self.made)]
        self.spark.createDataFrame(row, "version long, salt binary, runs array<string>, made long").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"run-{self.made:05d}"
        with releasing(self.spark):
            rows.sortWithinPartitions(*_KEY).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*(f"{self.path}/{r}" for r in runs)) if runs else self.spark.createDataFrame([], _RUN)

    def add(self, batch: DataFrame) -> DataFrame:
        """Add ``batch`` (doc_id, text) as a run; the batch's anchors, written."""
        if len(self.runs) >= self.most_runs:
            self.compact()
        found = materialize(anchors(batch, self.salt))
        self.runs = [*self.runs, self._write(found.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "span")).alias("first")))]
        self._commit()
        return found

    def compact(self) -> None:
        """Merge all runs into one."""
        old = self.runs
        if len(old) > 1:
            self.runs = [self._write(merged(self.read(old)))]
            self._commit()
            self._empty(old)

    def _empty(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.createDataFrame([], _RUN).write.mode("overwrite").parquet(f"{self.path}/{name}")


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _windows(docs: DataFrame, wanted: DataFrame, salt: bytes) -> DataFrame:
    """``h, w, doc_id, start``: the windows of the wanted anchors (``d, spans``)."""
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, budget=SLICE):
            words = Words(texts, salt)
            found = anchors_of(words, named=False)
            span = found["start"] * 32 + found["count"]
            lists = [np.array(x or [], np.int64) for x in rows.column("spans").to_pylist()]
            keys = np.concatenate([np.full(len(x), i, np.int64) for i, x in enumerate(lists)]) << 40 | np.concatenate(lists)
            hit = np.isin(found["text"] << 40 | span, keys)
            count = found["count"][hit]
            which = np.repeat(np.arange(len(count)), count)
            start = found["start"][hit][which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]
            text = found["text"][hit][which]
            place = words.first[text] + start
            w = words.names(place, place + WINDOW)
            yield pa.RecordBatch.from_arrays([pa.array(found["h"][hit][which]), pa.array(w.view(np.int64)), rows.column("doc_id").take(pa.array(text)), pa.array(start)], schema=schema)

    joined = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "h long, w long, doc_id long, start long")


def repeated_spans(docs: DataFrame, index: FingerprintIndex, found: DataFrame) -> DataFrame:
    """``doc_id, a, b``: the words of a batch, just added, that windows which start earlier cover.

    ``found`` are the batch's anchors, ``docs`` (doc_id, text) the batch and all documents before it;
    documents must come in ascending order of doc_id, batch after batch."""
    own, older = index.read(index.runs[-1:]), index.read(index.runs[:-1])
    again = own.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    again = materialize(again.unionByName(own.select("h").join(older.select("h"), "h", "left_semi")).distinct())
    rows = own.withColumn("new", F.lit(True)).unionByName(older.withColumn("new", F.lit(False))).join(again, "h", "left_semi")
    contexts = materialize(rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min("new").alias("new")), again)
    first = contexts.where("n > 1").select(*_KEY, "first")
    later = materialize(found.join(first, _KEY).where(~F.struct("doc_id", "span").eqNullSafe(F.col("first"))).select("doc_id", "span"))
    count = F.pmod("span", F.lit(32))
    start = F.shiftright("span", 5)
    spans = later.select("doc_id", start.alias("a"), (start + count + WINDOW - 1).cast("long").alias("b"))
    several = materialize(contexts.groupBy("h").agg((F.min("ctx") != F.max("ctx")).alias("several"), F.max("new").alias("new")).where("several and new").select("h"))
    wanted = contexts.join(several, "h", "left_semi").groupBy(F.col("first.doc_id").alias("d")).agg(F.collect_set("first.span").alias("spans"))
    windows = materialize(_windows(docs, wanted, index.salt), several)
    drop(contexts, found)
    places = windows.groupBy("h", "w").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1").select("h", "w", "first")
    places = materialize(places)
    single = windows.join(places, ["h", "w"]).where(~F.struct("doc_id", "start").eqNullSafe(F.col("first"))).select("doc_id", F.col("start").alias("a"), (F.col("start") + WINDOW).alias("b"))
    return materialize(spans.unionByName(single), windows, places, later)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words that are left of each document, joined by spaces."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            out: list[list] = [[], [], []]
            for k, text in enumerate(texts):
                words = left = text.encode().split()
                gone = rows.column("gone")[k].values  # Arrow numbers, never Python objects
                if gone is not None and len(gone):
                    both = gone.to_numpy()
                    begin, end = both >> 32, both & 0xFFFFFFFF
                    inside = end <= len(words)
                    edge = np.bincount(begin[inside], minlength=len(words) + 1) - np.bincount(end[inside], minlength=len(words) + 1)
                    left = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
                for column, value in zip(out, (len(words), len(words) - len(left), b" ".join(left)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], schema=schema)

    packed = F.shiftleft(F.col("a"), 32).bitwiseOR(F.col("b"))
    gone = materialize(spans.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set(packed).alias("gone")))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def deduplicate(docs: DataFrame, batches: int = 3, path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of all documents, added to a new index in ``batches`` by ascending doc_id.

    The index stays under ``path`` for batches to come; without one its runs are emptied at the end."""
    docs = whole_text(docs)
    index = FingerprintIndex.create(docs.sparkSession, path)
    tops = docs.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(t) for t in tops}), None]
    found = []
    for low, high in zip(edges, edges[1:], strict=False):
        upto = docs if high is None else docs.where((F.col("doc_id") <= high) | F.col("doc_id").isNull())
        found.append(repeated_spans(upto, index, index.add(upto if low is None else upto.where(F.col("doc_id") > low))))
    if path is None:
        index._empty(index.runs)
    kept = without_spans(docs, reduce(DataFrame.unionByName, found))
    drop(*found)
    return kept
