"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation (operator 8).

A vector is a sparse row of integer weights over terms (its positions); a zero weight is no posting.
Candidates and queries are dealt by a hash of their ids into blocks of bounded size, and each pair of
blocks meets once.  There every query row walks its terms and scatters weight x posting into a dense
array of scores, one per candidate of the block; partition selection keeps the k highest.  The
blocks' winners (k per query and block) are merged by a windowed rank.

Weights and scores are 64-bit integers; a score must fit them.

Edge cases: vectors null, or holding null or non-finite components, and rows without an id take
no part; terms that one vector has beyond another's length count as zero; an empty vector scores 0 with
every row; fewer than k candidates give all; ties go to the smaller id; rows that repeat an id
are candidates each, and none of them answers a query of that id; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.sources.parquet import load_table

#: vectors in a block at most about this many (dealt by hash); a block pair is one task's unit of work
MAX_BLOCK = 16_384
MIN_BLOCK = 1_024


def weights(batch: pa.Table, scale: float) -> np.ndarray:
    """Rows x terms matrix of floor(scale * component); shorter rows are padded with zeros."""
    column = batch.column("vec").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    sizes = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
    flat = np.floor(np.asarray(column.flatten(), dtype=np.float64) * scale).astype(np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def postings(matrix: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the candidates that hold it (None: all of them) and their weights."""
    out = []
    for t in range(matrix.shape[1]):
        column = np.ascontiguousarray(matrix[:, t])
        held = np.flatnonzero(column)
        out.append((None, column) if len(held) == len(column) else (held, column[held]))
    return out


def accumulate(query: np.ndarray, lists: list, n: int) -> np.ndarray:
    """Scores of n candidates for one sparse query row, a term at a time."""
    scores = np.zeros(n, dtype=np.int64)
    for t in np.flatnonzero(query[:len(lists)]).tolist():
        held, weight = lists[t]
        if held is None:
            scores += query[t] * weight
        else:
            scores[held] += query[t] * weight
    return scores


def block_winners(cand: pa.Table, quer: pa.Table, k: int, scale: float):
    """(query id, candidate id, score) of the k best candidates of one block for each query row."""
    ids = np.asarray(cand.column("id").combine_chunks())
    order = np.argsort(ids, kind="stable")
    lists = postings(weights(cand, scale)[order])
    ids = ids[order]
    found = ([], [], [])
    query_ids = np.asarray(quer.column("id").combine_chunks())
    for qid, row in zip(query_ids.tolist(), weights(quer, scale)):
        scores = accumulate(row, lists, len(ids))
        usable = ids != qid
        pick = np.flatnonzero(usable)
        if len(pick) > k:
            bound = np.partition(scores[pick], -k)[-k]
            pick = np.flatnonzero(usable & (scores >= bound))
            pick = pick[np.argsort(-scores[pick], kind="stable")][:k]   # ids ascend, so ties keep the smaller
        found[0].extend([qid] * len(pick))
        found[1].extend(ids[pick].tolist())
        found[2].extend(scores[pick].tolist())
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), found)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vec_col: str = "embedding", block: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest integer inner products of every row
    that meets ``is_query`` with all other rows."""
    vec = F.col(vec_col).cast("array<double>")
    usable = vectors.where(vec.isNotNull() & F.col(id_col).isNotNull()) \
        .where(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = usable.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), is_query.alias("q"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("nq")).first()
    if block is None:
        width = vectors.sparkSession.sparkContext.defaultParallelism
        block = min(MAX_BLOCK, max(MIN_BLOCK, math.ceil(counts["n"] / (2 * width))))
    n_cand = max(1, math.ceil(counts["n"] / block))
    n_query = max(1, math.ceil(counts["nq"] / MAX_BLOCK))

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cand = rows.select("id", "vec", own(n_cand).alias("cb"), every(n_query).alias("qb"))
    quer = rows.where("q").select("id", "vec", own(n_query).alias("qb"), every(n_cand).alias("cb"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_winners(left, right, k, scale)

    won = cand.groupBy("cb", "qb").cogroup(quer.groupBy("cb", "qb")) \
        .applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return won.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
