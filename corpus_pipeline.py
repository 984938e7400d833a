"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.llm import lines, packing, quality, secrets, simhash
from skald.llm.shared import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the rated rows of ``docs``, accepts.

    Every row is judged by its text alone (null: empty), so equal rows go or stay together, whatever
    their doc_id; with ratings of fewer than two grades all stay; columns pass unchanged; no rows give none."""
    return quality.keep_good(docs, quality.fit(quality.sample(docs, table(spark, sf_dir, "labels"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs of any length; ``n_chars`` is counted anew.

    Null text becomes empty; a document whose lines all repeat stays with empty text; a null doc_id
    comes first; further columns, ``n_lines`` and ``n_removed`` among them, pass unchanged; no rows give none."""
    kept = lines.deduplicate(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each class of five-word Jaccard 0.8 or more.

    Of equal rows and of equal doc_ids one stays as of any others; a null doc_id stays only where all
    of its class are null; texts without words (null, empty, white space) are one class; further
    columns pass unchanged; no rows give none."""
    return simhash.without_near_duplicates(docs, words=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark; ``n_chars`` is counted anew.

    Null text stays null, with null ``n_chars``; every row stays, also repeated ones; further columns
    pass unchanged; no rows give none."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 4096 tokens.

    Null and empty texts are their end id alone; every row, also a repeated one or one without doc_id,
    is packed; further columns are left out; no rows give no pieces."""
    return packing.pack_documents(docs, end_id=1, capacity=4096)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: The stages learn, hash and tokenise: SQL can't express them, tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
