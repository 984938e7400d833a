"""Helpers that every operator of this subpackage uses: shared storage and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at a time; longer texts go alone.
TEXT_BUDGET = 2_000_000


#: Shuffle files go with the execution that made them; its result is in files of its own.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Of the C library, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, local mode (tests) takes a temporary one, a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skald-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/skald-{uuid.uuid4().hex}"


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Executions inside drop their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, *used: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends at files that survive lost executors.

    ``zstd`` makes large texts and media smaller, at the cost of memory outside the heap for each writer. Materialized tables ``used``, which nothing else needs, are emptied once ``df`` is written."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with releasing(spark):
        df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    drop(*used)
    return back


def drop(*tables: DataFrame) -> None:
    """Empty materialized tables that nothing reads any more. No rows come from Python: that would start, and keep, workers of another kind."""
    for t in tables:
        t.sparkSession.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema)).write.mode("overwrite").parquet(_PATHS.pop(t))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``more`` and ``text`` with null read as empty; extra columns of any name are left out."""
    return docs.select("doc_id", *more, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def give_back() -> None:
    """Return memory that this process freed to the system: a worker lives on beside others, and its pools would keep it between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = TEXT_BUDGET) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of ``batches`` whose texts together stay within ``budget`` characters, with those texts (null: empty); memory freed by then goes back at the end."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        begin = total = 0
        for i, text in enumerate(texts):
            if text is None:
                text = texts[i] = ""
            if i > begin and total + len(text) > budget:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, total = i, 0
            total += len(text)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]
    batch = texts = text = None
    give_back()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
