"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.llm import bpe, lines, mpegts, packing, quality, rans, secrets, simhash, substrings, topk
from skald.llm.shared import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.read_media(mpegts.store(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_and_decode(table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.write_and_read(table(spark, sf_dir, "documents"), end_id=2)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), end_id=1, capacity=4096)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit(quality.sample(docs, table(spark, sf_dir, "labels"))))


QUERIES = {f.__name__: f for f in (op1_topk, op2_mpegts, op3_line_dedup, op4_simhash, op5_bpe, op6_secrets, op7_rans, op8_packing, op9_substrings, op10_quality)}

#: DuckDB SQL for what SQL can express. The others hash, tokenise, learn or pack; tests hold them against brute force.
ORACLES = {
    "op1_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    # Every run of lines, of any length.
    "op3_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
        l AS (SELECT doc_id, raw, list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(13))) AS t FROM d),
        s AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM l),
        e AS (SELECT doc_id, t, i, unnest(range(i, len(t) + 1)) AS j FROM s),
        w AS (SELECT doc_id, i, j, list_sum(list_transform(t[i:j], lambda x: length(x))) AS chars, j - i || ' ' || sha256(array_to_string(t[i:j], chr(10))) AS key FROM e),
        f AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1 AS later FROM w WHERE chars >= 20),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE later),
        h AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
        SELECT l.doc_id, CAST(len(raw) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string([x FOR x, k IN raw IF NOT list_contains(coalesce(gone, []), k)], chr(10)), '')) AS kept_sha256
        FROM l LEFT JOIN h ON l.doc_id = h.doc_id""",
    "op9_substrings": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
        s AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER o AS win, count(*) OVER o AS n FROM t
              WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
        k AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY n, win ORDER BY doc_id, i) > 1 AS later FROM s),
        g AS (SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM k),
        h AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN h ON d.doc_id = h.doc_id""",
}
