"""The inverted index as DataFrames: postings, term frequencies, document frequencies, vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from skald.functions.text import STOPWORDS, index_tokens, raw_tokens, split_words, stemmed
from skald.operators.query import stem_word

FIELDS = ("title", "snippet", "body", "url", "headings")
COLUMNS = ("id", "title", "url", "snippet", "body", "headings", "source", "date", "lang")


def tokens_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``id, field, pos, token``: every token of every field; addresses keep all their words.

    The fields are exploded together, so that the table is read and stemmed in one pass."""
    words = [F.struct(F.lit(f).alias("field"), (raw_tokens(F.col(f)) if f == "url" else index_tokens(F.col(f), F.col("lang"))).alias("words")) for f in fields]
    rows = docs.select("id", "lang", F.explode(F.array(*words)).alias("f")).select("id", "lang", F.col("f.field").alias("field"), F.posexplode("f.words").alias("pos", "raw"))
    english = F.coalesce((F.col("lang") == "en") & (F.col("field") != "url"), F.lit(False))
    return stemmed(rows, "raw", english, "token").select("id", "field", "pos", "token")


#: Positions of a field lie beyond those of the fields before it.
FIELD_BITS = 26
#: Words that are grouped at once, unless one document has more, and words whose tokens a task remembers.
SLICE, REMEMBERED = 1 << 19, 1 << 18
SHAPES = {
    "entries": f"token string, id string, {', '.join(f'tf_{f} long' for f in FIELDS)}, places array<int>",
    "postings": "field string, token string, id string, positions array<int>, tf long",
    "pairs": "token string, id string",
}


def _codes(words: list[str], known: dict[str, tuple[str, str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens, and for each word its token's number as it is and in English; -1 for words that the index leaves out."""
    numbers: dict[str, int] = {"": -1}
    plain, english = [], []
    for w in words:
        both = known.get(w)
        if both is None:
            both = ("", "") if len(w) < 2 else (w, "" if w in STOPWORDS else stem_word(w))
            if len(known) < REMEMBERED:
                known[w] = both
        plain.append(numbers.setdefault(both[0], len(numbers) - 1))
        english.append(numbers.setdefault(both[1], len(numbers) - 1))
    return list(numbers)[1:], np.array(plain, np.int64), np.array(english, np.int64)


def _bits(n: int) -> int:
    return max(n, 1).bit_length()


def _grouped(docs: pa.RecordBatch, shape: str, known: dict[str, tuple[str, str]]) -> pa.RecordBatch | None:
    """The rows of ``shape`` of a few documents: numbers (document, token, place in order) are sorted, not strings."""
    lists = [docs.column(f) for f in FIELDS]
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int64)
    words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    tokens, plain, english = _codes(words.dictionary.to_pylist(), known)
    at, n = words.indices.to_numpy(), docs.num_rows
    group = np.repeat(np.arange(len(sizes)), sizes)  # a field of a document
    field, doc = np.divmod(group, n)
    in_english = np.tile(docs.column("english").to_numpy(zero_copy_only=False), len(FIELDS)) & (np.arange(len(sizes)) // n != FIELDS.index("url"))
    code = np.where(in_english[group], english[at], plain[at])
    kept = code >= 0
    before = np.concatenate([[0], np.cumsum(kept)])
    place = (before[:-1] - before[np.cumsum(sizes) - sizes][group] + (field << FIELD_BITS))[kept]
    code, field, doc = code[kept], field[kept], doc[kept]
    if not len(code):
        return None
    seq = _bits(len(code))
    key = np.sort(((doc << _bits(len(tokens))) + code << seq) + np.arange(len(code)))
    order, same = key & ((1 << seq) - 1), key >> seq
    if shape == "postings":
        same = same * len(FIELDS) + field[order]
    starts = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    first = order[starts]
    columns = {"token": pa.array(tokens).take(pa.array(code[first])), "id": docs.column("id").take(pa.array(doc[first]))}
    if shape == "pairs":
        return pa.RecordBatch.from_pydict(columns)
    ends = np.append(starts, len(order)).astype(np.int32)
    places = lambda p: pa.ListArray.from_arrays(pa.array(ends), pa.array(p.astype(np.int32)))
    if shape == "postings":
        names = pa.array(FIELDS).take(pa.array(field[first]))
        return pa.RecordBatch.from_pydict({"field": names, **columns, "positions": places(place[order] & ((1 << FIELD_BITS) - 1)), "tf": pa.array(np.diff(ends).astype(np.int64))})
    of = field[order]
    counts = {f"tf_{f}": pa.array(np.add.reduceat(of == i, starts, dtype=np.int64)) for i, f in enumerate(FIELDS)}
    return pa.RecordBatch.from_pydict({**columns, **counts, "places": places(place[order])})


def _grouping(shape: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, str]] = {}
        for batch in batches:
            size = np.cumsum(sum(np.diff(batch.column(f).offsets.to_numpy()).astype(np.int64) for f in FIELDS))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, "right")))
                rows = _grouped(batch.slice(start, end - start), shape, known)
                if rows is not None:
                    yield rows
                start = end

    return run


def _per_document(docs: DataFrame, shape: str) -> DataFrame:
    """The rows of ``shape``, grouped within each row of ``docs``: no token crosses the network."""
    english = F.coalesce(F.col("lang") == "en", F.lit(False)).alias("english")
    return docs.select(F.col("id").cast("string").alias("id"), english, *(split_words(F.col(f)).alias(f) for f in FIELDS)).mapInArrow(_grouping(shape), SHAPES[shape])


def repeats(docs: DataFrame) -> bool:
    """Whether two rows share an id; then their tokens are one document's."""
    return not docs.groupBy("id").count().where("count > 1").isEmpty()


def postings(docs: DataFrame) -> DataFrame:
    """``field, token, id, positions, tf``."""
    rows = _per_document(docs, "postings")
    if not repeats(docs):
        return rows
    return rows.groupBy("field", "token", "id").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.sum("tf").alias("tf"))


def entries(docs: DataFrame) -> DataFrame:
    """``token, id``, a term frequency per field and ``places``, the sorted positions over all fields."""
    rows = _per_document(docs, "entries")
    if not repeats(docs):
        return rows
    return rows.groupBy("token", "id").agg(*(F.sum(f"tf_{f}").alias(f"tf_{f}") for f in FIELDS), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``token, df`` without an index."""
    rows = _per_document(docs, "pairs")
    return document_frequencies(rows.distinct() if repeats(docs) else rows)


def document_frequencies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token").agg(F.count("*").alias("df"))


@dataclass
class Index:
    """The entries, the vocabulary (``token, df``) and the number of documents.

    A stored index is three tables under one folder: entries in ranges of (token, id), vocabulary in
    ranges of token, both sorted, so that a query for some tokens reads only the files and row
    groups whose statistics admit them; any session can open it."""

    entries: DataFrame
    vocabulary: DataFrame
    total: int

    @classmethod
    def of(cls, docs: DataFrame) -> Index:
        """An index that is not stored, for a small corpus: its entries are kept in memory and on disk, once for
        equal ``docs``, until ``release``."""
        rows = entries(docs).persist(StorageLevel.MEMORY_AND_DISK)
        return cls(rows, document_frequencies(rows), docs.count())

    def release(self) -> None:
        self.entries.unpersist()

    @classmethod
    def store(cls, docs: DataFrame, path: str) -> Index:
        spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = entries(docs).persist(StorageLevel.DISK_ONLY)  # ranges are drawn from the rows before they are dealt out: tokens are cut once for both
        found.repartitionByRange(parts, "token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/entries")
        found.unpersist()
        rows = spark.read.parquet(f"{path}/entries")
        document_frequencies(rows.select("token")).repartitionByRange(parts, "token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/vocabulary")
        docs.agg(F.count("*").alias("total")).write.mode("overwrite").parquet(f"{path}/total")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/total").first().total)


def upsert(docs: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """``docs`` with the last version of each new id in place of the old one."""
    last = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), F.col(order)).alias("row")).select("id", "row.*").drop(order)
    return docs.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)


def clear_by(docs: DataFrame, source: str | None = None, host: str | None = None, url_host=None) -> DataFrame:
    """``docs`` without those of a source and, or, a URL's host; no condition removes all."""
    condition = F.lit(True)
    if source:
        condition &= F.col("source") == source
    if host:
        condition &= url_host(F.col("url")) == host
    return docs.where(~F.coalesce(condition, F.lit(False)))
