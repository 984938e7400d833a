"""The driver's tables as document verticals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.operators import index

NOW = "2024-06-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as web documents; every tenth has no date."""
    text, number = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("string")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(365)).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "documents").select(
        number.alias("id"), F.substring(F.substring_index(text, "\n", 1), 1, 80).alias("title"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), number).alias("url"),
        F.substring(text, 1, 200).alias("snippet"), text.alias("body"), F.lit("").alias("headings"), "source", F.when(F.col("doc_id") % 10 == 0, "").otherwise(day).alias("date"), "lang")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a vertical of small documents, with transport-like fields in ``meta``."""
    number = F.col("p_partkey").cast("string")
    meta = F.create_map(F.lit("from"), F.concat(F.lit("Port"), F.pmod("p_partkey", F.lit(7))), F.lit("to"), F.concat(F.lit("Port"), F.pmod("p_partkey", F.lit(5))), F.lit("depart"), F.concat(F.lit("2024-03-0"), F.pmod("p_partkey", F.lit(9)) + 1))
    return table(spark, sf_dir, "part").select(number.alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("https://parts.example.com/"), number).alias("url"), F.col("p_type").alias("snippet"), F.lit("").alias("body"), F.lit("").alias("headings"), F.col("p_brand").alias("source"), F.lit("2024-01-01").alias("date"), F.lit("en").alias("lang"), meta.alias("meta"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` as a vertical whose texts speak of travel."""
    number, key = F.col("n_nationkey").cast("string"), F.col("n_nationkey")
    empty = F.lit("")
    return table(spark, sf_dir, "nation").select(number.alias("id"), F.concat(F.when(key % 2 == 0, "Flight ticket to city ").otherwise("Ferry to city "), number).alias("title"), F.concat(F.lit("https://trips.example.com/"), number).alias("url"), F.concat(F.when(key % 3 == 0, "Hotel near town ").otherwise("Road to town "), number).alias("snippet"), empty.alias("body"), empty.alias("headings"), F.concat(F.lit("region"), F.col("n_regionkey")).alias("source"), F.lit("2024-01-01").alias("date"), F.lit("en").alias("lang"))


_BUILT: dict[tuple[str, str, str], str] = {}
_KINDS = {"web": web, "parts": parts, "trips": trips}


def indexed(spark: SparkSession, sf_dir: str, kind: str) -> index.Index:
    """The index of a vertical: stored once for each session and input in the shared folder, opened by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/skald-index-{uuid.uuid4().hex}"
        index.Index.store(_KINDS[kind](spark, sf_dir), path)
        _BUILT[key] = path
    return index.Index.open(spark, _BUILT[key])


def vocabulary_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``token, df`` of a vertical: from its index where one is stored, else counted without building one."""
    if (spark.sparkContext.applicationId, sf_dir, kind) in _BUILT:
        return indexed(spark, sf_dir, kind).vocabulary
    return index.vocabulary(_KINDS[kind](spark, sf_dir))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; in local mode a temporary folder where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="skald-index-")
