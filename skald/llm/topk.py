"""Exact top-k inner-product search by multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and standard deviation. Over one segment of
``s`` components two vectors' inner product is at most ``s * (mean * mean' + dev * dev')``
(Cauchy-Schwarz on what is left after the means), which is the same as a lower bound on their
distance. A first pass scores every query against a bounded sample and so gives it a floor: its
k-th best score can't be lower. The bound is then taken from coarse to fine: pairs that stay below
the query's floor leave after each level, the exact integer product is computed for survivors, and
the floor rises with what a block has found.

Queries and candidates are cut into blocks of bounded size (``QUERY_CELLS`` and ``CANDIDATE_CELLS``
components) and every query block meets every candidate block in its own group, so no side is
broadcast and no task grows with the input; a candidate is sent once for each block of queries.
Rows are dealt by a hash of their place in the input, not by vec_id, so that a vec_id or a vector
that many rows share fills no single block.

Defined results: components become floor(64 * x), within the range of a long; vectors that are null
or hold a null or non-finite component, and rows without vec_id, take no part; a query meets vectors
of its own dimension, every row but its own, also others of its vec_id; fewer candidates give
fewer ranks; ties go to the smaller vec_id; repeated rows count each as a candidate and as a query;
scores are exact and stop at the range of a long; empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skald.llm.shared import materialize, partitions

#: Components of a block, of either side; rows of a candidate block at least, where that many tasks can work.
QUERY_CELLS, CANDIDATE_CELLS, LEAST_ROWS = 1 << 19, 1 << 21, 1024
#: Queries and candidates that are compared at a time, and expected rows of the first pass's sample.
QUERIES, CANDIDATES, SAMPLE = 1024, 2048, 4096
LEVELS = (1, 4, 16, 32)
#: Share of surviving pairs below which products are taken pair by pair.
SPARSE = 0.02
#: Rows up to which the table of dimensions is broadcast.
DIMENSIONS = 100_000
_EXACT, _LONG = 2.0**53, 2.0**63


def quantized(vectors: DataFrame, is_query) -> DataFrame:
    """``vec_id, seq, asks, dim, v``: the integer components of every vector that takes part, ``seq`` telling equal rows apart."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    good = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    return good.select("vec_id", F.monotonically_increasing_id().alias("seq"), "asks", F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c.cast("double") * 64).cast("long")).alias("v"))


def segment_bounds(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of ``vectors`` from above: scaled means and deviations."""
    edges = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
    sizes = np.diff(edges)
    sums, squares = (np.add.reduceat(x, edges[:-1], 1) for x in (vectors, vectors**2))
    means = sums / sizes
    devs = np.sqrt(np.maximum(squares / sizes - means**2, 0))
    return np.concatenate([means, devs], 1) * np.sqrt(np.concatenate([sizes, sizes]))


def products(queries: np.ndarray, candidates: np.ndarray, wide: bool, pairs: bool = False) -> np.ndarray:
    """Exact integer products (of rows with rows if ``pairs``): as floats below 2**53, else as longs that stop at their range."""
    of = (lambda a, b: np.einsum("ij,ij->i", a, b)) if pairs else (lambda a, b: a @ b.T)
    near = of(queries.astype(float), candidates.astype(float))
    if not wide:
        return near
    low = of(queries, candidates)  # exact modulo 2**64
    over = (np.abs(near) > _LONG * (1 - 1e-9)) & ((np.abs(near) > _LONG * (1 + 1e-9)) | ((near > 0) != (low > 0)))
    return np.where(over, np.where(near > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min), low)


def block_top(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, seq: np.ndarray, floor: np.ndarray, k: int, alive_after: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, candidate rows and scores of each query's k best that reach its ``floor`` (long; candidates come by ascending vec_id).

    ``alive_after`` gets the pairs that are left before the first and after each level."""
    n, dim = queries.shape
    none = np.zeros(0, np.int64)
    if not n or not len(candidates):
        return none, none, none
    qf, cf = queries.astype(float), candidates.astype(float)
    wide = float(np.abs(qf).max(initial=0)) * float(np.abs(cf).max(initial=0)) * dim >= _EXACT
    lowest = floor == np.iinfo(np.int64).min
    floor = floor.copy() if wide else np.where(lowest, -np.inf, floor.astype(float))
    levels = [(segment_bounds(qf, s), segment_bounds(cf, s)) for s in LEVELS if s < dim]
    slack, norm = 1e-6 * np.sqrt((qf**2).sum(1))[:, None], np.sqrt((cf**2).sum(1))[None, :]
    full = np.zeros(n, bool)
    rows, columns, best = none, none, np.zeros(0, floor.dtype)
    for a in range(0, len(candidates), CANDIDATES):
        b = min(a + CANDIDATES, len(candidates))
        alive = own[:, None] != seq[None, a:b]
        counts = [int(alive.sum())]
        if not lowest.all():
            least = np.where(lowest, -np.inf, floor.astype(float))[:, None]
            for mine, others in levels:
                alive &= mine @ others[a:b].T + slack * norm[:, a:b] >= least
                counts.append(int(alive.sum()))
                if not counts[-1]:
                    break
        if alive_after is not None:
            alive_after += [0] * (len(levels) + 1 - len(alive_after))
            for i in range(len(levels) + 1):
                alive_after[i] += counts[min(i, len(counts) - 1)]
        if not counts[-1]:
            continue
        if counts[-1] < SPARSE * alive.size:
            r, c = np.nonzero(alive)
            score = products(queries[r], candidates[a + c], wide, pairs=True)
        else:
            some = np.flatnonzero(alive.any(0))
            table = products(queries, candidates[a + some], wide)
            # Candidates come by vec_id: once k are held, an equal score is too late.
            good = alive[:, some] & np.where(full[:, None], table > floor[:, None], table >= floor[:, None])
            if good.sum() > 8 * n * k:
                reach = np.where(good, table, np.iinfo(np.int64).min if wide else -np.inf)
                good &= table >= np.partition(reach, max(0, reach.shape[1] - k), 1)[:, max(0, reach.shape[1] - k), None]
            r, at = np.nonzero(good)
            c, score = some[at], table[r, at]
        rows, columns, best = np.concatenate([rows, r]), np.concatenate([columns, a + c]), np.concatenate([best, score])
        ranked = np.lexsort((columns, ~best if wide else -best, rows))
        rows, columns, best = rows[ranked], columns[ranked], best[ranked]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == k - 1
        full[rows[last]] = True
        floor[rows[last]] = np.maximum(floor[rows[last]], best[last])
        lowest &= ~full
        keep = (place < k) & (best >= floor[rows])
        rows, columns, best = rows[keep], columns[keep], best[keep]
    return rows, columns, best.astype(np.int64)


def _stacked(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows.v.to_numpy()).astype(np.int64) if len(rows) and len(rows.v.iloc[0]) else np.zeros((len(rows), 1), np.int64)


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products."""
    vectors = materialize(quantized(vectors, is_query))
    tasks = partitions(vectors.sparkSession)
    rows_of = lambda cells: F.greatest(F.lit(1), F.floor(F.lit(cells) / F.greatest(F.lit(1), F.col("dim"))))
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("m"), F.count_if("asks").alias("n"))
    least = F.least(F.lit(tasks), F.ceil(F.col("m") / LEAST_ROWS))
    sizes = materialize(sizes.select("dim", "m", F.ceil(F.col("n") / rows_of(QUERY_CELLS)).cast("int").alias("qn"), F.greatest(least, F.ceil(F.col("m") / rows_of(CANDIDATE_CELLS))).cast("int").alias("cn")))
    blocks = F.broadcast(sizes) if sizes.count() <= DIMENSIONS else sizes
    placed = vectors.join(blocks, "dim").withColumn("hash", F.xxhash64("seq"))
    mine, all_of = lambda n: F.pmod("hash", F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["dim", "q", "c", "tag", "vec_id", "seq", "v"]
    low = np.iinfo(np.int64).min

    def tops(rows: pd.DataFrame):
        """The queries' rows, and slices of them with their best."""
        rows = rows.sort_values(["tag", "vec_id", "seq"], kind="stable")
        q, c = rows[rows.tag == 0], rows[rows.tag == 1]
        a, b, seq = _stacked(q), _stacked(c), c.seq.to_numpy()
        floor = q.floor.fillna(low).to_numpy(np.int64) if "floor" in q else np.full(len(q), low)
        for at in range(0, len(q), QUERIES):
            part = slice(at, at + QUERIES)
            row, column, score = block_top(a[part], b, q.seq.to_numpy()[part], seq, floor[part], k)
            yield q.iloc[part], c, row, column, score

    def floors(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"asked": q.seq.to_numpy()[row[last]], "floor": score[last]}) for q, _, row, _, score in tops(rows) for last in [np.arange(len(row)) - np.searchsorted(row, row) == k - 1]]
        return pd.concat([pd.DataFrame({"asked": [], "floor": []}), *out]).astype("int64")

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": q.vec_id.to_numpy()[row], "seq": q.seq.to_numpy()[row], "vec_id": c.vec_id.to_numpy()[column], "score": score}) for q, c, row, column, score in tops(rows)]
        return pd.concat([pd.DataFrame({"query_id": [], "seq": [], "vec_id": [], "score": []}), *out]).astype("int64")

    asking = placed.where("asks").withColumn("q", mine("qn"))
    one = F.lit(0)
    sample = placed.where(F.pmod(F.xxhash64("seq", F.lit(1)), F.col("m")) < SAMPLE).select("*", all_of("qn").alias("q"))
    first = asking.select("*", one.alias("c"), F.lit(0).alias("tag")).select(columns).unionByName(sample.select("*", one.alias("c"), F.lit(1).alias("tag")).select(columns))
    known = materialize(first.groupBy("dim", "q").applyInPandas(floors, "asked long, floor long"))
    asking = asking.join(known, F.col("seq") == F.col("asked"), "left").select("*", F.lit(0).alias("tag"), all_of("cn").alias("c")).select(*columns, "floor")
    others = placed.select("*", mine("cn").alias("c"), F.lit(1).alias("tag"), F.lit(None).cast("long").alias("floor"), all_of("qn").alias("q")).select(*columns, "floor")
    found = asking.unionByName(others).groupBy("dim", "q", "c").applyInPandas(best, "query_id long, seq long, vec_id long, score long")
    ranked = Window.partitionBy("query_id", "seq").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
