"""Exact top-k inner-product search over integer vectors, term at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_batches

#: Queries that one pass scores, and rows that share a dense score array: at most 2048 x 2048 scores of 8 bytes.
QUERY_BLOCK, ROW_BLOCK = 2048, 2048


def postings(rows: list[list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows that hold it, their weights); zeros are left out."""
    width = max(map(len, rows), default=0)
    dense = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        dense[i, : len(r)] = r
    out = {}
    for t in range(width):
        at = np.flatnonzero(dense[:, t])
        if len(at):
            out[t] = at, dense[at, t]
    return out


def accumulate(queries: dict[int, tuple[np.ndarray, np.ndarray]], n_queries: int, rows: dict[int, tuple[np.ndarray, np.ndarray]], n_rows: int) -> np.ndarray:
    """Dense scores (rows x queries): each term's postings are scattered, weighted by each query that holds it."""
    most = sum(float(np.abs(w.astype(float)).max()) * float(np.abs(rows[t][1].astype(float)).max()) for t, (_, w) in queries.items() if t in rows)
    if most >= 2.0**62:  # sums of these products may wrap
        scores = np.zeros((n_rows, n_queries), object)
        queries = {t: (q, w.astype(object)) for t, (q, w) in queries.items()}
        rows = {t: (at, v.astype(object)) for t, (at, v) in rows.items()}
    else:
        scores = np.zeros((n_rows, n_queries), np.int64)
    for t, (q, weights) in queries.items():
        if t in rows:
            at, values = rows[t]
            if len(q) == n_queries:
                scores[at] += values[:, None] * weights
            else:
                scores[np.ix_(at, q)] += values[:, None] * weights
    return scores


def as_longs(scores: np.ndarray) -> np.ndarray:
    """Scores that may be Python's whole numbers, as longs."""
    if scores.dtype == object and len(scores) and not -(2**63) <= scores.min() <= scores.max() < 2**63:
        raise OverflowError("a score does not fit 64 bits")
    return scores.astype(np.int64, copy=False)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; ties go to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        sure = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        at = np.concatenate([sure, tied[np.argsort(ids[tied], kind="stable")[: k - len(sure)]]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, the k rows of highest integer inner product.

    Components are floor(scale * x). Queries are taken in blocks of QUERY_BLOCK, one pass of the table for each block,
    so that no memory grows with the table; within a pass each task keeps k rows for a query of the block. Scores are
    whole numbers; where a block's sums might not fit 64 bits they are accumulated as Python's, and a score that does not
    fit fails the job (OverflowError) instead of wrapping. Null vectors and those with null or non-finite components take no part; nor do
    rows with a null id. Vectors of unequal length count as padded with zeros. Ties go to the smaller id; a row is not
    its own candidate, and of rows that repeat an id each is a candidate of other ids' queries; queries that repeat an id share one list. An empty table, or one
    without queries, gives no rows.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    real = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    # a component beyond 64 bits would be cut to the greatest long
    fits = lambda x: F.when(F.abs(x.cast("double")) * scale < 2.0**63, F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("long"))
    rows = real.select("vec_id", F.transform("v", fits).alias("v"))
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "v"])
    scratch = Scratch(spark, "topk")
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    if blocks > 1:  # blocks by hash, so each is read alone; a block's size is checked as it is fetched
        blocks = -(-n // (QUERY_BLOCK // 2))
        queries = scratch.keep(queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))

    def scorer(held: list):
        q_ids, q_rows = np.array([r[0] for r in held], np.int64), [list(r[1]) for r in held]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = postings(q_rows)
            kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in held]
            for batch in batches:
                for begin in range(0, batch.num_rows, ROW_BLOCK):
                    part = batch.slice(begin, ROW_BLOCK)
                    ids = part.column(0).to_numpy()
                    scores = accumulate(terms, len(held), postings(part.column(1).to_pylist()), len(ids))
                    for j in range(len(held)):
                        mine = ids != q_ids[j]
                        s, i = np.concatenate([kept[j][0], as_longs(scores[mine, j])]), np.concatenate([kept[j][1], ids[mine]])
                        at = best(s, i, k)
                        kept[j] = s[at], i[at]
            q = np.concatenate([np.full(len(s), q_ids[j]) for j, (s, _) in enumerate(kept)] or [np.empty(0, np.int64)])
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([i for _, i in kept])), pa.array(np.concatenate([s for s, _ in kept]))], names=["query_id", "vec_id", "score"])

        return run

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    schema = "query_id long, vec_id long, score long"
    if blocks == 1:
        return ranked(rows.mapInArrow(scorer(queries.collect()), schema))
    out = f"{scratch.base}/found"
    for b in range(blocks):
        for begin in range(0, len(held := queries.where(F.col("b") == b).drop("b").collect()), QUERY_BLOCK):
            ranked(rows.mapInArrow(scorer(held[begin : begin + QUERY_BLOCK]), schema)).write.mode("append").parquet(out)
    return ranked(spark.read.parquet(out).drop("rank"))
