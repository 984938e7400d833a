"""Line deduplication by a suffix array over line IDs, built by distributed prefix doubling.

Every line is an ID (its trimmed bytes' hash, 128 bits). Round ``k`` sorts the pairs of ranks at a
line and ``2**k`` lines on, over range partitions, and numbers them in that order: the rank of a
suffix by its first ``2**(k+1)`` lines. Suffixes with one rank are an interval of the suffix array
whose common prefix is at least so long; a rank that occurs once is settled and leaves.

A line goes if it lies in a run of lines, of any number, that has at least ``min_chars``
characters and also begins earlier (smaller document, then smaller line). Runs are not listed by
length: a suffix's common prefix with an earlier one reaches ``min_chars`` just if it reaches the
``m`` lines that the suffix needs for them, and two suffixes share ``m`` lines just if the ranks by
``2**k <= m`` lines agree at both ends of the ``m`` lines. So each suffix is asked for its least
``m`` (and, to cover what is left of a run after its last such start, each line for the least run
that ends there); the intervals of equal answers give the first one and its later copies, and the
union of the copies is that of all maximal repeated runs. Doubling ends when no rank repeats or no
suffix needs more lines. DataFrame functions only; least members of groups are written before
they are joined, so that the join can be split where a line or a run is very frequent.

Defined results: null text is empty; a text is cut at line feeds; lines are compared without
leading and trailing spaces, tabs and carriage returns; a short line alone never counts, within a
longer run it does, as do empty lines; text without marked lines stays byte for byte; a document
whose lines all repeat is left empty, its row stays; exact repetitions of a whole row (doc_id too)
are one document; a null doc_id comes first; empty tables give none; further columns pass unchanged,
but for ``n_lines`` and ``n_removed`` where those are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skald.llm.shared import drop, materialize, partitions

MIN_CHARS = 20
#: A document: whether it has a doc_id, the doc_id, its text's hash.
_ID = ["known", "doc", "th"]


def _place():
    return F.struct(*_ID, "i")


def _lines(docs: DataFrame) -> DataFrame:
    """``known, doc, th, i, chars, x, y``: every line of every document."""
    cut = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    line = cut.select(*_ID, F.col("i").cast("long").alias("i"), F.btrim("raw", F.lit(" \t\r")).alias("line"))
    return line.select(*_ID, "i", F.length("line").cast("long").alias("chars"), F.xxhash64("line").alias("x"), F.xxhash64(F.lit(7), "line").alias("y")).distinct()


def _least_runs(rows: DataFrame, min_chars: int) -> DataFrame:
    """``known, doc, th, i, size``: from each line, and up to each line, the least run of two lines or more that has ``min_chars``.

    Lines lie on a scale by the characters before and up to them; the line where a run is long
    enough is the nearest one on that scale, found by a running least (or greatest) line."""
    of = Window.partitionBy(*_ID)
    upto = F.sum("chars").over(of.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    scaled = rows.withColumn("upto", upto).withColumn("least", F.min("chars").over(of)).where(F.col("least") < min_chars)
    before, short = F.col("upto") - F.col("chars"), F.col("chars") < min_chars
    event = lambda way, asks, at: F.struct(F.lit(way).alias("way"), F.lit(asks).alias("asks"), at.alias("at"))
    ends, begins = event(0, 0, -F.col("upto")), event(1, 0, before)
    asked = F.when(short, F.array(ends, begins, event(0, 1, -(before + min_chars)), event(1, 1, F.col("upto") - min_chars))).otherwise(F.array(ends, begins))
    events = scaled.select(*_ID, "i", F.inline(asked))
    on = Window.partitionBy(*_ID, "way").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    line = F.when(F.col("asks") == 0, F.col("i"))
    found = events.withColumn("other", F.when(F.col("way") == 0, F.min(line).over(on)).otherwise(F.max(line).over(on))).where("asks = 1 and other is not null")
    return found.select(*_ID, F.least("i", "other").alias("i"), (F.abs(F.col("other") - F.col("i")) + 1).alias("size")).distinct()


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of the keys that repeat, in the keys' order, with their first place."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
    ordered = groups.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    # Range partitions come in the keys' order, so partition number and place are a rank.
    return materialize(ordered.select(*keys, "first", F.monotonically_increasing_id().alias("rank")))


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``known, doc, th, i, size``: runs that begin earlier too and together cover every such run of ``min_chars``."""
    rows = materialize(_lines(docs))
    asked = materialize(_least_runs(rows, min_chars))
    longest = asked.agg(F.max("size")).first()[0] or 1
    keys, found, k = ["x", "y"], [], 0
    while True:
        ranked = _ranked(rows, keys)
        more = [(~_place().eqNullSafe(F.col("first")) & (F.col("chars") >= min_chars)).alias("later")] if k == 0 else []
        ranks = materialize(rows.join(ranked, keys).select(*_ID, "i", "rank", *more), ranked, rows)
        if k == 0:
            found.append(materialize(ranks.where("later").select(*_ID, "i", F.lit(1).cast("long").alias("size"))))
        else:
            mine = asked.where((F.col("size") >= 1 << k) & (F.col("size") < 2 << k)).withColumn("j", F.col("i") + F.col("size") - (1 << k))
            both = mine.join(ranks.withColumnRenamed("rank", "a"), [*_ID, "i"]).join(ranks.select(*_ID, F.col("i").alias("j"), F.col("rank").alias("b")), [*_ID, "j"])
            both = materialize(both.select(*_ID, "i", "size", "a", "b"))
            shared = ["size", "a", "b"]
            groups = materialize(both.groupBy(*shared).agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1"))
            found.append(materialize(both.join(groups, shared).where(~_place().eqNullSafe(F.col("first"))).select(*_ID, "i", "size"), both, groups))
        if 2 << k > longest or ranks.isEmpty():
            drop(ranks, asked)
            return reduce(DataFrame.unionByName, found)
        need = asked.where(F.col("size") >= 2 << k).select(*_ID).distinct()
        on = Window.partitionBy(*_ID).orderBy("i").rangeBetween(1 << k, 1 << k)
        pairs = ranks.join(need, _ID, "left_semi").withColumn("y", F.first("rank").over(on)).where(F.col("y").isNotNull())
        rows = materialize(pairs.select(*_ID, "i", F.col("rank").alias("x"), "y"), ranks)
        k += 1


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` freed of later copies of repeated line runs; with ``counts``, also ``n_lines`` and ``n_removed``."""
    docs = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    marks = repeated_runs(docs, min_chars).groupBy(*_ID, "i").agg(F.max(F.col("i") + F.col("size")).alias("end"))
    by_line = Window.partitionBy(*_ID).orderBy("i")
    fresh = marks.withColumn("fresh", F.coalesce(F.col("i") > F.max("end").over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    runs = fresh.withColumn("run", F.sum("fresh").over(by_line)).groupBy(*_ID, "run").agg(F.min("i").alias("a"), F.max("end").alias("b"))
    intervals = F.collect_list(F.struct("a", "b")).alias("skald_gone")
    # The added columns have names of their own, so that columns of ``docs`` never clash with them.
    gone = runs.groupBy(*_ID).agg(intervals, F.sum(F.col("b") - F.col("a")).alias("skald_removed")).select(*(F.col(c).alias(f"skald_{c}") for c in _ID), "skald_gone", "skald_removed")
    text, doc = F.col("skald_docs.text"), F.col("skald_docs.doc_id")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.exists("skald_gone", lambda g: (i >= g["a"]) & (i < g["b"]))), "\n")
    same = (doc.isNotNull() == F.col("skald_known")) & (F.coalesce(doc, F.lit(0)) == F.col("skald_doc")) & (F.xxhash64(text) == F.col("skald_th"))
    joined = docs.alias("skald_docs").join(gone, same, "left")
    columns = [F.when(F.col("skald_gone").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"skald_docs.`{c}`") for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    if counts:
        total = (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")
        columns += [total.alias("n_lines"), F.coalesce("skald_removed", F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns)
