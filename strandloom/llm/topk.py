"""Exact top-k search by MaxScore over quantised vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
SCALE = 256
SHARD_ROWS = 4096  # vectors of one shard's postings
BLOCK_ROWS = 512  # queries that traverse a shard together


def maxscore(queries: np.ndarray, q_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best (query id, vector id, score) of each query in one shard, ties to the smaller id; a vector is not its own.

    A term is a component. Its posting of a vector is what the product adds above the least that any vector of the shard
    gives, so all postings are non-negative and a term's bound is its largest. Per query, terms are sorted by bound: the
    non-essential ones are those whose bounds sum to less than the gap to the k-th best score so far, so a vector with
    nothing but them cannot compete. Essential postings are traversed for all vectors; the others are probed one term
    at a time for vectors that are still competitive.
    """
    low, high = shard.min(axis=0), shard.max(axis=0)
    by_id = np.argsort(ids, kind="stable")
    postings, ids = np.ascontiguousarray(shard[by_id].T), ids[by_id]
    out = []
    for q, own in zip(queries, q_ids.tolist(), strict=True):
        base = np.minimum(q * low, q * high)
        bound = np.maximum(q * low, q * high) - base
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        least = int(base.sum())
        after = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
        other = ids != own
        # a first threshold: exact scores of some vectors that the largest terms favour
        lead = order[:8]
        partial = least + q[lead] @ postings[lead] - base[lead].sum()
        live = np.flatnonzero(other)
        if len(live) > k:
            probe = live[np.argpartition(-partial[live], min(4 * k, len(live) - 1))[: 4 * k]]
            exact = np.sort(q @ postings[:, probe])[::-1]
            threshold = int(exact[k - 1]) if len(exact) >= k else -(1 << 62)
        else:
            threshold = -(1 << 62)
        # essential: while the terms that follow could still lift a vector from nothing to the threshold
        essential = max(len(lead), int(np.searchsorted(-(least + after), -threshold, "right")))
        essential = min(essential, len(order))
        rest = order[len(lead) : essential]
        score = partial + (q[rest] @ postings[rest] - base[rest].sum() if len(rest) else 0)
        live = live[score[live] + after[essential] >= threshold]
        score = score[live]
        for j in range(essential, len(order)):
            t = order[j]
            score = score + q[t] * postings[t, live] - base[t]
            stay = score + after[j + 1] >= threshold
            if not stay.all():
                live, score = live[stay], score[stay]
        best = np.lexsort((ids[live], -score))[:k]
        out += [(own, int(ids[live[i]]), int(score[i])) for i in best]
    return out


_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _BEST.empty_table()

        def matrix(t: pa.Table) -> np.ndarray:
            flat = t["v"].combine_chunks()
            return (flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy().reshape(len(t), -1)

        rows = maxscore(matrix(left), left["id"].to_numpy(), matrix(right), right["id"].to_numpy(), k)
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], _BEST)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k highest integer inner products of each query (vec_id, v array<long>) with every vector but those of its own id.

    Vectors are dealt to shards of about `shard_rows`, queries to blocks of about `block_rows`; each pair of a block and a
    shard is searched by MaxScore and the shards' best are merged, so neither side is gathered anywhere. Vectors of
    different lengths are compared with their like only. Returns query_id, rank (from 1), vec_id, score; ties go to the
    smaller vec_id; fewer vectors than k give fewer rows; repeated rows are each a candidate; empty inputs give no rows.
    """
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    series = lambda many, name: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)
    size = F.size("v").alias("size")
    left = queries.select(F.col("vec_id").cast("long").alias("id"), "v", size, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), series(shards, "shard"))
    right = vectors.select(F.col("vec_id").cast("long").alias("id"), "v", size, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), series(blocks, "block"))
    on = ["block", "shard", "size"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x as double; null or non-finite components, null or empty vectors go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = embeddings.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)
    return whole.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def op6_maxscore(spark, sf_dir: str) -> DataFrame:
    """Contract query: the five best of each vector whose id is divisible by 50."""
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where("vec_id % 50 = 0"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
