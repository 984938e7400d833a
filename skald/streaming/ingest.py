"""Streaming ingestion: pages arrive in micro-batches, become documents and are upserted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skald.functions.html import page_documents
from skald.functions.text import crawl_host
from skald.operators.crawl import MAX_PER_HOST
from skald.operators.index import upsert


def pages_stream(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string", files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def unseen_pages(pages: DataFrame) -> DataFrame:
    """Each address once over the whole stream, as the crawler's seen set has it."""
    return pages.dropDuplicates(["url"])


def ingest(pages: DataFrame, store: str, checkpoint: str, now: str):
    """Start a query that writes every micro-batch's documents as a new version of the store, and ends when all input is read.

    Versions are immutable folders ``store/v=<epoch>``; a batch that is run again writes the same folder."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # Within a batch the later row, in the order of its files, is the later version.
        docs = page_documents(batch, now).withColumn("seq", F.monotonically_increasing_id())
        old = spark.read.parquet(f"{store}/v={epoch - 1}") if epoch else None
        new = upsert(docs.drop("seq").limit(0) if old is None else old, docs)
        new.write.mode("overwrite").parquet(f"{store}/v={epoch}")

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_changes(pages: DataFrame, store: str, checkpoint: str, now: str, first_only: bool = False):
    """Start a query that appends every micro-batch's documents as changes, and ends when all input is read.

    A batch costs what it holds, not what the store holds: its last document of each id goes to
    ``store/epoch=<n>``, which a batch that is run again replaces. ``current`` reads the store,
    ``compact`` merges old changes. With ``first_only`` an address counts once over the whole stream."""
    rows = unseen_pages(pages) if first_only else pages

    def step(batch: DataFrame, epoch: int) -> None:
        docs = page_documents(batch, now).withColumn("seq", F.monotonically_increasing_id())
        last = upsert(docs.drop("seq").limit(0), docs)
        last.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    """The last version of every document, of the changes ``upto`` an epoch."""
    rows = spark.read.option("basePath", store).parquet(store)
    if upto is not None:
        rows = rows.where(F.col("epoch") <= upto)
    fields = [c for c in rows.columns if c not in ("id", "epoch")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*fields), F.col("epoch")).alias("row")).select("id", "row.*")


def compact(spark: SparkSession, store: str, out: str, upto: int) -> None:
    """Write the documents of all changes ``upto`` an epoch as the one change ``upto`` of a new store ``out``; later changes are copied."""
    current(spark, store, upto).write.mode("overwrite").parquet(f"{out}/epoch={upto}")
    later = spark.read.option("basePath", store).parquet(store).where(F.col("epoch") > upto)
    later.write.mode("append").partitionBy("epoch").parquet(out)


def host_limited(pages: DataFrame, per_host: int = MAX_PER_HOST) -> DataFrame:
    """``host, url, n`` of the first ``per_host`` pages of each host over the whole stream: the state of a host is its count."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        for rows in frames:
            kept = rows.sort_values("url", kind="stable").head(max(0, per_host - count))
            if len(kept):
                yield pd.DataFrame({"host": key[0], "url": kept["url"].to_numpy(), "n": range(count + 1, count + 1 + len(kept))})
                count += len(kept)
        state.update((count,))

    hosted = pages.select(crawl_host(F.col("url")).alias("host"), "url").where("host <> ''")
    return hosted.groupBy("host").applyInPandasWithState(step, "host string, url string, n long", "count long", "append", GroupStateTimeout.NoTimeout)
