"""Snapshots, exports, imports and configuration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_SCHEMA = "ID string, Title string, Url string, Snippet string, Body string, Headings string, Source string, Date string, Lang string, meta map<string,string>"
COLUMNS = ("id", "title", "url", "snippet", "body", "headings", "source", "date", "lang", "meta")


def payload_documents(rows: DataFrame, column: str = "value") -> DataFrame:
    """Documents of JSON payloads: a bare array, ``{"data": [...]}`` or ``{"docs": [...]}``."""
    text = F.trim(column)
    bare = F.from_json(text, f"array<struct<{_struct()}>>")
    wrapped = F.from_json(text, f"struct<data: array<struct<{_struct()}>>, docs: array<struct<{_struct()}>>>")
    docs = F.when(text.startswith("["), bare).otherwise(F.coalesce(wrapped["data"], wrapped["docs"]))
    return rows.select(F.explode(docs).alias("d")).select(*(F.coalesce(F.col(f"d.{n}"), F.lit("")).alias(n.lower()) for n in ("ID", "Title", "Url", "Snippet", "Body", "Headings", "Source", "Date", "Lang")), F.col("d.meta").alias("meta"))


def _struct() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (p.strip().split(" ") for p in DOC_SCHEMA.split(", ")))


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return payload_documents(spark.read.text(path, wholetext=True))


def save_snapshot(docs: DataFrame, path: str) -> None:
    """The native snapshot: Parquet, a folder per vertical; only verticals in ``docs`` are replaced."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vertical").parquet(path)


def load_snapshot(spark: SparkSession, path: str, vertical: str | None = None) -> DataFrame:
    docs = spark.read.parquet(path)
    return docs.where(F.col("vertical") == vertical) if vertical else docs


def _interchange(docs: DataFrame) -> DataFrame:
    names = ("ID", "Title", "Url", "Snippet", "Body", "Headings", "Source", "Date", "Lang")
    own = {c.lower() for c in docs.columns}
    meta = [F.col("meta")] if "meta" in own else []
    return docs.select(*((F.col(n.lower()) if n.lower() in own else F.lit("")).alias(n) for n in names), *meta)


def export_json(docs: DataFrame, path: str, array: bool = False) -> None:
    """JSON lines with the interchange names, ``meta`` too; as one ``array`` in one file if that is asked for."""
    if not array:
        _interchange(docs).write.mode("overwrite").json(path)
        return
    # The array's brackets and commas are lines of their own, so that no task holds more than a document.
    lines = _interchange(docs).select(F.to_json(F.struct("*")).alias("value"), F.col("ID"))
    first = lines.agg(F.min("ID")).first()[0]
    with_commas = lines.select(F.concat(F.when(F.col("ID").eqNullSafe(F.lit(first)) & F.lit(first is not None), F.lit("")).otherwise(F.lit(",")), "value").alias("value"), F.lit(1).alias("n"), "ID")
    spark = docs.sparkSession
    ends = spark.createDataFrame([("[", 0, None), ("]", 2, None)], "value string, n int, ID string")
    with_commas.unionByName(ends).coalesce(1).sortWithinPartitions("n", "ID").select("value").write.mode("overwrite").text(path)


def page_source(pages: DataFrame, most: int = 2 << 20) -> DataFrame:
    """Fetched pages that count: a status below 400 (where there is one) and content, cut to ``most`` bytes."""
    if "status" in pages.columns:
        pages = pages.where("status is null or status < 400")
    cut = F.when(F.octet_length("html") > most, F.make_valid_utf8(F.substring(F.encode("html", "UTF-8"), 1, most).cast("string"))).otherwise(F.col("html"))
    return pages.where("html is not null and html <> ''").withColumn("html", cut)


def save_frontier(queue: DataFrame, seen: DataFrame, path: str) -> None:
    """A crawl's state: ``queue`` (url, depth) and ``seen`` (url). Write to another folder than the one it was read from."""
    queue.select("url", F.col("depth").cast("int").alias("depth")).write.mode("overwrite").parquet(f"{path}/queue")
    seen.select("url").distinct().write.mode("overwrite").parquet(f"{path}/seen")


def load_frontier(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``queue`` and ``seen`` as they were saved."""
    return spark.read.schema("url string, depth int").parquet(f"{path}/queue"), spark.read.schema("url string").parquet(f"{path}/seen")


def import_frontier(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from the interchange file ``{"queue": [{"u", "depth"}], "seen": [...]}``."""
    state = spark.read.schema("queue array<struct<u: string, depth: int>>, seen array<string>").option("multiLine", True).json(path)
    queue = state.select(F.explode("queue").alias("q")).select(F.coalesce("q.u", F.lit("")).alias("url"), F.coalesce("q.depth", F.lit(0)).alias("depth"))
    return queue, state.select(F.explode("seen").alias("url"))


CRAWL_STATS = {"pages_fetched": "pagesFetched", "blocked_by_robots": "blockedByRobots", "crawl_delay_seconds": "crawlDelaySeconds", "sitemap_count": "sitemapCount", "last_fetch": "lastFetch"}


def save_crawl_stats(stats: DataFrame, path: str, now: str) -> None:
    """A JSON line for each host, with the interchange names and the time of saving."""
    known = [F.col(c).alias(CRAWL_STATS[c]) for c in CRAWL_STATS if c in stats.columns]
    stats.select("host", *known, F.lit(now).alias("timestamp")).write.mode("overwrite").json(path)


def load_crawl_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of hosts from those lines, or from the interchange file ``{"hosts": {host: {...}}, "timestamp"}``."""
    host = "pagesFetched bigint, blockedByRobots bigint, crawlDelaySeconds int, sitemapCount int, lastFetch string"
    fields = host.replace(" bigint", ": bigint").replace(" int", ": int").replace(" string", ": string")
    rows = spark.read.schema(f"host string, {host}, timestamp string, hosts map<string,struct<{fields}>>").option("multiLine", False).json(path)
    names = [F.col(w).alias(c) for c, w in CRAWL_STATS.items()]
    lines = rows.where("host is not null").select("host", *names, "timestamp")
    whole = rows.where("hosts is not null").select(F.explode("hosts").alias("host", "s"), "timestamp").select("host", "s.*", "timestamp").select("host", *names, "timestamp")
    return lines.unionByName(whole)


SETTINGS_SCHEMA = "synonyms map<string,array<string>>, priors map<string,double>, weights map<string,double>"


def save_settings(spark: SparkSession, path: str, synonyms: dict | None = None, priors: dict | None = None, weights: dict | None = None) -> None:
    """Synonyms and priors, normalized, and field weights: one row of JSON."""
    row = spark.createDataFrame([(synonyms or {}, priors or {}, weights or {})], SETTINGS_SCHEMA)
    row.select(normalized_synonyms(F.col("synonyms")).alias("synonyms"), normalized_priors(F.col("priors")).alias("priors"), "weights").coalesce(1).write.mode("overwrite").json(path)


def load_settings(spark: SparkSession, path: str) -> dict[str, dict]:
    """Those settings that are set, as keyword arguments of ``search.Settings``."""
    row = spark.read.schema(SETTINGS_SCHEMA).json(path).first()
    return {k: v for k, v in row.asDict().items() if v} if row else {}


def normalized_synonyms(m: Column) -> Column:
    """Keys and values trimmed and lower-cased, blanks dropped."""
    tidy = F.transform_values(m, lambda k, v: F.filter(F.transform(v, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return F.map_filter(F.transform_keys(tidy, lambda k, v: F.lower(F.trim(k))), lambda k, v: (k != "") & (F.size(v) > 0))


def normalized_priors(m: Column) -> Column:
    return F.map_filter(F.transform_keys(m, lambda k, v: F.lower(F.trim(k))), lambda k, v: (k != "") & (v > 0))


def image_documents(records: DataFrame) -> DataFrame:
    """Image records in document layout: the thumbnail is the snippet, the image the address."""
    return records.select("id", "title", F.col("imageUrl").alias("url"), F.col("thumbnailUrl").alias("snippet"), "source", "date")


def video_documents(records: DataFrame) -> DataFrame:
    """Video records in document layout: the duration is the snippet, the thumbnail the body."""
    return records.select("id", "title", "url", F.col("duration").alias("snippet"), F.col("thumbnailUrl").alias("body"), "source", "date")


def video_items(rows: DataFrame, column: str, now: str) -> DataFrame:
    """Video records of the first API's answer (``items``); entries without an id are dropped."""
    got = F.from_json(column, "struct<items: array<struct<id: struct<videoId: string>, snippet: struct<title: string, publishedAt: string, channelId: string>>>>")
    v = rows.select(F.explode(got["items"]).alias("v")).select(F.col("v.id.videoId").alias("vid"), F.col("v.snippet.title").alias("title"), F.col("v.snippet.publishedAt").alias("date")).where("vid <> ''")
    url = F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("vid"))
    return v.select(F.sha1(url).alias("id"), "title", url.alias("url"), F.lit("").alias("duration"), F.concat(F.lit("https://i.ytimg.com/vi/"), "vid", F.lit("/hqdefault.jpg")).alias("thumbnailUrl"), F.lit("www.youtube.com").alias("source"), F.coalesce(F.nullif("date", F.lit("")), F.lit(now)).alias("date"))


def video_list(rows: DataFrame, column: str) -> DataFrame:
    """Video records of the second API's answer (``list``): seconds as "<n>s", epoch as an instant."""
    got = F.from_json(column, "struct<list: array<struct<title: string, url: string, duration: int, thumbnail_url: string, created_time: bigint>>>")
    v = rows.select(F.explode(got["list"]).alias("v")).select("v.*")
    return v.select(F.sha1("url").alias("id"), "title", "url", F.concat(F.col("duration").cast("string"), F.lit("s")).alias("duration"), F.col("thumbnail_url").alias("thumbnailUrl"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("source"), F.date_format(F.timestamp_seconds("created_time"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
