"""Exact top-k inner products in three phases with a uniform threshold.

A score is the sum of the partial scores of a vector's slices, so a query has one score list for each slice. Phase
one gathers each list's best entries from every block of candidates and takes their exact scores: the k-th best of
them is a floor under the final k-th. An entry can only reach the floor if one of its m partial scores reaches
floor / m, so phase two collects, from all lists, the entries at or above that uniform threshold; they are sufficient.
Phase three resolves those entries' remaining partial scores exactly and keeps the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespar.llm.common import cut, ship

RESULT = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id and ``v``: floor(factor * component) of each vector (vec_id, embedding); rows with a null id, vector
    or component, or one that isn't finite, are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(y * factor).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to ``width``."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(array.offsets.to_numpy())
    flat = array.values.to_numpy(zero_copy_only=False)[array.offsets[0].as_py() : array.offsets[-1].as_py()] if len(array) else np.zeros(0, np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: in floating point where no sum can pass 2**53, else in whole numbers (modulo 2**64)."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2.0**53 else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For one query, the places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= least)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))][:k]


def _meet(queries: DataFrame, candidates: DataFrame, work, schema: str) -> DataFrame:
    ship(queries.sparkSession)
    candidates = candidates.toDF(*candidates.columns)  # else both sides' columns have the same identity
    return queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(work, schema)


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; each task first keeps its own k best, so few rows of a query meet."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, slices: int = 4, factor: int = 256, query_rows: int = 4096, block_rows: int = 8192, least_blocks: int = 24) -> DataFrame:
    """For each query, its ``k`` highest integer inner products with other vectors: query_id, rank, vec_id, score.

    ``vectors``: vec_id, embedding. Queries are the rows that ``is_query`` holds for; candidates are all rows with another
    vec_id. Queries and candidates are dealt into blocks of about ``query_rows`` and ``block_rows`` by hash, and every pair
    of blocks is one task's work, so memory is bounded at any size and no block is broadcast. From each pair of
    blocks at most ``k`` rows of a query come out, however many vectors are equal. Ties go to the smaller
    vec_id. Vectors of unequal length are compared as if filled up with zeros. Of queries with the same vec_id the least
    vector is taken; repeated candidates give repeated rows. Fewer than ``k`` candidates: all; no rows give no rows."""
    rows = scaled(vectors.select("vec_id", "embedding"), factor)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count(F.when(is_query, 1)).alias("q")).first()
    width = max(1, size.width or 0)
    bounds = [round(s * width / slices) for s in range(slices + 1)]
    qn, cn = max(1, -(-size.q // query_rows)), max(least_blocks, -(-size.n // block_rows))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("qb", block(qn, 1))
    queries = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cn - 1))))
    # the second hash sets equal vectors of unequal ids apart; ids alone deal evenly
    candidates = rows.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v", F.lit(2)), F.lit(cn)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qn - 1))))

    def partials(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        return [_product(q[:, a:b], c[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def spans(n: int, m: int) -> Iterator[slice]:
        step = max(1, (1 << 22) // max(1, m))  # of queries at a time: 4 million scores a slice
        return (slice(a, min(a + step, n)) for a in range(0, n, step))

    def emit(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        columns = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table([pa.array(x.astype(np.int64)) for x in columns], names=["query_id", "vec_id", "score"])

    def work(with_floor: bool):
        def run(query: pa.Table, candidate: pa.Table) -> pa.Table:
            if not query.num_rows or not candidate.num_rows:
                return emit([])
            q, c = _matrix(query.column("v"), width), _matrix(candidate.column("v"), width)
            qid, cid = query.column("vec_id").to_numpy(), candidate.column("vec_id").to_numpy()
            floor = query.column("floor").to_numpy(zero_copy_only=False) if with_floor else None
            found = []
            for part in spans(len(q), len(c)):
                lists = partials(q[part], c)
                for i in range(part.stop - part.start):
                    j = part.start + i
                    other = cid != qid[j]
                    if with_floor and floor[j] == floor[j]:
                        threshold = floor[j] / slices
                        enough = np.flatnonzero(other & np.logical_or.reduce([x[i] >= threshold for x in lists]))
                    elif with_floor:  # fewer than k entries are known: all are needed
                        enough = np.flatnonzero(other)
                    else:  # a list's k best may be the query itself and its equals: one more
                        reach = min(k + 1, len(c))
                        enough = np.unique(np.concatenate([np.argpartition(-x[i], reach - 1)[:reach] for x in lists]))
                        enough = enough[other[enough]]
                    score = np.sum([x[i][enough] for x in lists], axis=0, dtype=np.int64)
                    if with_floor and floor[j] == floor[j]:
                        enough, score = enough[score >= floor[j]], score[score >= floor[j]]
                    best = _best(score, cid[enough], k)
                    found.append((np.full(len(best), qid[j]), cid[enough][best], score[best]))
            return emit(found)

        return run

    first = _top(_meet(queries.select("qb", "cb", "vec_id", "v"), candidates.select("qb", "cb", "vec_id", "v"), work(False), RESULT), k)
    floors = cut(first.where(F.col("rank") == k).select(F.col("query_id").alias("floor_id"), F.col("score").cast("double").alias("floor")))
    queries = queries.join(floors, F.col("vec_id") == F.col("floor_id"), "left").select("qb", "cb", "vec_id", "v", "floor")
    final = _top(_meet(queries, candidates.select("qb", "cb", "vec_id", "v"), work(True), RESULT), k)
    return final.select("query_id", "rank", "vec_id", "score")
