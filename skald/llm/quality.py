"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's score is one weighted sum of hashed words and of binned shares of its characters
(capitals, digits, signs, word lengths); ordered thresholds turn it into the probability of each
grade, P(grade <= k) = logistic(threshold_k - score), all grades sharing the weights. Grades here
are 0 (rated bad), 1 (rated good but toxic) and 2 (rated good and not toxic). The expected grade
ranks documents; the tail probability P(grade >= 2) selects them.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hashes of their
doc_id. Hashed words enter if their share differs between grades by over ``LEAST`` standard
deviations in the sample, which leaves some hundred of them: held out, more words make the model
worse (README). Only these words' numbers, never texts or all words, come to the driver. Defined
results: null text is empty; a label with null in either rating, or without a document, is no
rating, repeated labels count as often; with ratings of fewer than two grades nothing can be
learnt, and every document is kept with the grade seen (or null); extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skald.llm.shared import drop, materialize, text_slices, whole_text

SAMPLE = 16_000
PREFIX = 5
BUCKETS = 1 << 18
SHARES, BINS = 8, 10
GRADES = 3
LEAST = 14.0
#: Rows with a word at least.
SEEN = 5
WIDTH = BUCKETS + SHARES * BINS
_BYTES = {"upper": np.array([c in range(65, 91) for c in range(256)]), "digit": np.array([c in range(48, 58) for c in range(256)])}
_SIGNS = np.array([chr(c) in "!|#*<>{}=~^$%&@\\" for c in range(256)])
_STOPS = np.array([chr(c) in ".,;:?'\"()-" for c in range(256)])


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (BUCKETS - 1)


def shares(text: str, words: list[str]) -> list[int]:
    """The bins of a text's shares, numbered after the word buckets."""
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size, n = max(1, int(data.sum())), max(1, len(words))
    lower = int(data[97:123].sum())
    upper = int(data[_BYTES["upper"]].sum())
    values = (upper / max(1, upper + lower), 4 * data[_BYTES["digit"]].sum() / size, 4 * data[_SIGNS].sum() / size, 4 * data[_STOPS].sum() / size, (size / n - 2) / 12, len(set(words)) / n, min(1.0, np.log10(n) / 5), 20 * data[10] / size)
    return [BUCKETS + BINS * k + min(BINS - 1, max(0, int(BINS * float(v)))) for k, v in enumerate(values)]


def _split(text: str) -> tuple[list[str], set[str]]:
    """All words, and the distinct ones without punctuation together with the beginnings of longer ones."""
    words = text.lower().split()
    distinct = {w.strip(".,;:!?\"'()") for w in set(words)}
    return words, distinct | {f"{w[:PREFIX]}*" for w in distinct if len(w) > PREFIX}


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``doc_id, grade, ids``, written: grades and feature numbers of at most ``size`` rated documents."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").alias("rated"), F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2).alias("grade"))
    chosen = rated.orderBy(F.xxhash64("rated"), "rated", "grade").limit(size)
    joined = whole_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("rated")).select("doc_id", "grade", "text")  # at most ``size`` rows are broadcast
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            ids = []
            for text in texts:
                words, distinct = _split(text)
                ids.append(np.unique(np.array([*map(bucket, distinct), *shares(text, words)], np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("grade"), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    found = materialize(joined.mapInArrow(run, "doc_id long, grade int, ids array<int>"))
    # More only where doc_ids repeat.
    return found if found.count() <= size else materialize(found.orderBy(F.xxhash64("doc_id", "grade", "ids")).limit(size), found)


def clear_words(rows: DataFrame, least: float = LEAST) -> np.ndarray:
    """The numbers of the features that enter: clear words, and every share's bin that occurs."""
    totals = np.zeros(GRADES)
    for r in rows.groupBy("grade").count().collect():
        totals[r.grade] = r["count"]
    counts = rows.select("grade", F.explode("ids").alias("id")).groupBy("id").agg(*(F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(GRADES)))
    every = sum((F.col(f"n{g}") for g in range(GRADES)), F.lit(0))
    clear = F.lit(False)
    for part in ([1, 2], [1], [2]):  # above a threshold, or one grade
        share = float(totals[part].sum() / max(1, totals.sum()))
        expected = every * share
        clear |= F.abs(sum((F.col(f"n{g}") for g in part), F.lit(0)) - expected) / F.sqrt(F.greatest(expected * (1 - share), F.lit(1e-9)) + 1) > least
    kept = counts.where((clear & (every >= SEEN)) | (F.col("id") >= BUCKETS)).select("id")
    return np.array(sorted(r.id for r in kept.collect()), np.int64)


class Model:
    def __init__(self, weights: dict[int, float], thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds
        self.words: dict[str, float] = {}

    def score(self, text: str) -> float:
        words, distinct = _split(text)
        new = distinct.difference(self.words)
        if len(self.words) + len(new) > 400_000:
            self.words.clear()
            new = distinct
        for w in new:
            self.words[w] = self.weights.get(bucket(w), 0.0)
        seen = {b for b in (bucket(w) for w in distinct if self.words[w])}  # a bucket counts once
        return sum(sorted(self.weights[b] for b in seen)) + sum(self.weights.get(b, 0.0) for b in shares(text, words))

    def grades(self, score: float) -> tuple[float, float]:
        """The expected grade and the probability of the highest grade."""
        below = 1 / (1 + np.exp(np.clip(score - self.thresholds, -500, 500)))
        return float((1 - below).sum()), float(1 - below[-1])


def likelihood(params: np.ndarray, rows: np.ndarray, ids: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of ``grades`` and its gradient; ``params``: weights, first threshold, logarithms of the gaps."""
    n = len(params) - GRADES + 1
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    weights, gaps = params[:n], np.exp(params[n + 1 :])
    thresholds = params[n] + np.concatenate([[0.0], np.cumsum(gaps)])
    score = np.bincount(rows, weights[ids], len(grades))
    full = np.concatenate([[-np.inf], thresholds, [np.inf]])
    high, low = logistic(full[grades + 1] - score), logistic(full[grades] - score)
    slope_high, slope_low = high * (1 - high), low * (1 - low)
    chance = np.maximum(high - low, 1e-12)
    at_threshold = np.bincount(grades + 1, slope_high / chance, GRADES + 1) - np.bincount(grades, slope_low / chance, GRADES + 1)
    inner = at_threshold[1:-1]
    by_weight = np.bincount(ids, -((slope_high - slope_low) / chance)[rows], n)
    gradient = np.concatenate([by_weight, [inner.sum()], [inner[k:].sum() * gaps[k - 1] for k in range(1, GRADES - 1)]])
    return float(np.log(chance).mean()), gradient / len(grades)


def fit(sampled: DataFrame, rounds: int = 400, rate: float = 0.2, decay: float = 1e-5, least: float = LEAST) -> Model | int | None:
    """A model, or the only grade that there is, or None without ratings."""
    present = sorted(r.grade for r in sampled.select("grade").distinct().collect())
    if len(present) < 2:
        return int(present[0]) if present else None
    kept = clear_words(sampled, least)
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(WIDTH, -1, np.int32)
        place[kept] = np.arange(len(kept))
        for batch in batches:
            ids = [(x := place[np.array(i, np.int64)])[x >= 0].astype("<i4").tobytes() for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(ids, pa.binary())], schema=schema)

    data = sorted((r.doc_id, r.grade, bytes(r.ids)) for r in sampled.mapInArrow(run, "doc_id long, grade int, ids binary").collect())
    drop(sampled)
    grades = np.array([g for _, g, _ in data], np.int64)
    rows = np.repeat(np.arange(len(data)), [len(x) // 4 for _, _, x in data])
    ids = np.frombuffer(b"".join(x for _, _, x in data), "<i4").astype(np.int64)
    share = np.array([(grades <= k).mean() for k in range(GRADES - 1)]).clip(0.01, 0.99)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(len(kept)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        grad = likelihood(params, rows, ids, grades)[1]
        grad[: len(kept)] -= decay * params[: len(kept)]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    thresholds = params[len(kept)] + np.concatenate([[0.0], np.cumsum(np.exp(params[len(kept) + 1 :]))])
    return Model({int(i): float(w) for i, w in zip(kept, params, strict=False)}, thresholds)


def rate(docs: DataFrame, model: Model | int | None, least: float = 0.8) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, keep``."""
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            if isinstance(model, Model):
                found = [model.grades(model.score(t)) for t in texts]
            else:
                found = [(model, None) if model is None else (float(model), float(model == GRADES - 1))] * len(texts)
            keep = [not isinstance(model, Model) or tail >= least for _, tail in found]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array([None if f[k] is None else round(f[k], 6) for f in found], pa.float64()) for k in (0, 1)), pa.array(keep)], schema=schema)

    return whole_text(docs).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def keep_good(docs: DataFrame, model: Model | int | None, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that the model accepts; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            keep = [not isinstance(model, Model) or model.grades(model.score(t))[1] >= least for t in texts]
            yield rows.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
