"""Exact top-k inner products by MaxScore over blocks of vectors.

A dimension is a query's term. Within a block what a term can add above its least is its
bound. While the k-th best score known is high enough, the terms of the smallest bounds
are non-essential: together they lift no vector to it. The essential terms are traversed
for all vectors of a step, the others are probed, the largest bounds first, only for
vectors that can still reach the k-th best score. That score rises with every step, and
with it the number of non-essential terms; where no term is essential the rest of the
block is passed over. Blocks are shards; their lists are merged by rank.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LONG = (-(2**63), 2**63 - 1)


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def maxscore(ids: np.ndarray, rows: np.ndarray, query_id: int, q: np.ndarray, k: int, step: int = 256) -> list[tuple[int, int]]:
    """The k best (vec_id, score) of a block for one query, ties to the smaller id. Exact: doubles hold the sums
    while these are below 2^53, else whole numbers of any size, which at the end are held within a long."""
    others = ids != query_id
    if not others.all():
        ids, rows = ids[others], rows[others]
    if not len(ids):
        return []
    biggest = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, len(q))
    kind = np.float64 if biggest < 2.0**53 else object
    terms = np.flatnonzero(q)
    q, rows = q[terms].astype(kind), rows[:, terms].astype(kind)
    ends = np.stack([q * rows.max(axis=0), q * rows.min(axis=0)])
    least, bound = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
    by_bound = np.array(sorted(range(len(terms)), key=bound.__getitem__), dtype=np.int64)  # the smallest first
    q, rows, least = q[by_bound], rows[:, by_bound], least[by_bound]
    upto = np.concatenate([np.zeros(1, kind), np.cumsum(bound[by_bound])])  # what the first terms can add together
    floor = least.sum() if len(least) else 0
    best: list[tuple] = []  # (-score, id), at most k
    for a in range(0, len(ids), step):
        known = -best[-1][0] if len(best) == k else None
        split = 0 if known is None else int(np.searchsorted(upto, known - floor, side="left")) - 1  # floor + upto[split] < known
        if split >= len(terms) and len(terms):
            break
        split = max(0, split)
        live, part = np.arange(len(ids[a : a + step])), rows[a : a + step]
        score = part[:, split:] @ q[split:] + (floor - least[split:].sum())
        while split:
            live_now = score + upto[split] >= known
            live, score = live[live_now], score[live_now]
            low = max(0, split - 8)
            score = score + part[live, low:split] @ q[low:split] - least[low:split].sum()
            split = low
        if known is not None:
            live, score = live[score >= known], score[score >= known]
        best = heapq.nsmallest(k, [*best, *zip((-score).tolist(), ids[a + live].tolist())])
    return [(i, max(_LONG[0], min(_LONG[1], int(-s)))) for s, i in best]


def _shard(k: int):
    def search(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            width = max(max(map(len, vectors["v"])), max(map(len, queries["v"])))
            ids, rows = vectors["vec_id"].to_numpy(), _matrix(vectors["v"], width)
            for query_id, q in zip(queries["vec_id"], _matrix(queries["v"], width)):
                out += [(query_id, i, s) for i, s in maxscore(ids, rows, query_id, q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return search


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` highest integer inner
    products over ``vectors``; both frames have vec_id and v (array<long>).

    Rows with a query's vec_id are its own and no candidates for it; repeated queries count
    once. Shorter vectors are filled with zeros. Ties go to the smaller vec_id. Rows with a
    null vec_id or v take no part. Every block of ``block`` vectors meets every block of
    queries in a group of its own, so a group's size is bounded.
    """
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    queries = queries.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    n_v, n_q = max(1, math.ceil(vectors.count() / block)), max(1, math.ceil(queries.count() / block))
    dealt = lambda df, n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n))
    left = vectors.withColumn("vb", dealt(vectors, n_v)).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    right = queries.withColumn("qb", dealt(queries, n_q)).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_v - 1).cast("long"))))
    lists = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(_shard(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, column: str = "embedding", scale: int = 1024, keep: tuple = ()) -> DataFrame:
    """vec_id, the columns ``keep`` and v = floor(scale * component); without vectors that are null or hold null or non-finite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col(column).isNotNull() & finite).select("vec_id", *keep, F.transform(column, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_topk(vectors, vectors.where("vec_id % 100 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
