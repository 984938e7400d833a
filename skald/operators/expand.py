"""Variants of query tokens: exact, prefix, one edit, synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT, PREFIX, SHORT_PREFIX, FUZZY, SYNONYM = 1.0, 0.7, 0.4, 0.5, 0.8


def within_one_edit(a, b):
    """Levenshtein distance of at most one; the length test prunes before the distance is computed."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) >= 0)


def expand(vocab: DataFrame, query_tokens: list[str], synonyms: dict[str, list[str]] | None = None, prefix: bool = True, fuzzy: bool = True, least_prefix: int = 2) -> DataFrame:
    """``q_token, token, mult``. The query's tokens are literals of a few rows; a scan of the vocabulary finds
    prefix and fuzzy variants together without a shuffle, and fuzzy ones only stay for tokens without a prefix variant."""
    spark = vocab.sparkSession
    known = {k.strip().lower(): [v for x in vs if (v := x.strip().lower())] for k, vs in (synonyms or {}).items()}
    literal = [(t, t, EXACT, 0) for t in query_tokens] + [(t, s, SYNONYM, 3) for t in query_tokens for s in known.get(t, [])]
    out = spark.createDataFrame(literal, "q_token string, token string, mult double, kind int")
    if query_tokens and (prefix or fuzzy):
        q, token = F.col("q_token"), F.col("token")
        words = vocab.select("token", F.explode(F.array(*map(F.lit, query_tokens))).alias("q_token")).where(token != q)
        starts = F.startswith(token, q) & (F.length(q) >= least_prefix) if prefix else F.lit(False)
        near = (F.length(q) >= 3) & within_one_edit(token, q) if fuzzy else F.lit(False)
        found = words.withColumn("kind", F.when(starts, 1).when(near, 2)).where("kind is not null")
        least = F.broadcast(found.groupBy("q_token").agg(F.min("kind").alias("least")))  # a row for each token asked for at most
        weight = F.when(F.col("kind") == 2, FUZZY).when(F.length(q) <= 2, SHORT_PREFIX).otherwise(PREFIX)
        out = out.unionByName(found.join(least, "q_token").where("kind = 1 or least = 2").select("q_token", "token", weight.alias("mult"), "kind"))
    # The earlier kind wins where several give the same variant.
    return out.groupBy("q_token", "token").agg(F.min_by("mult", "kind").alias("mult"))
