"""Nearest neighbours among vectors (id, label, v): pairs are made between blocks, best ones are kept in each block first."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.storage import saved

BLOCK_ROWS = 16384
ROUND_BLOCKS = 4  # blocks of vectors that queries meet at once
CHUNK_ROWS = 256  # queries of a block whose products are held at once

_NEAR = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("d", pa.float64())])


def _nearest(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _NEAR.empty_table()
        a, b = (np.array(t["v"].to_pylist(), np.float64) for t in (left, right))
        ids, others = left["id"].to_numpy(), right["other"].to_numpy()
        rows, square = [], (b * b).sum(axis=1)
        for at in range(0, len(a), CHUNK_ROWS):
            part = a[at : at + CHUNK_ROWS]
            # products tell which few can be among the nearest; their distances are then worked out as differences
            own = (part * part).sum(axis=1)[:, None]
            near = own + square - 2 * (part @ b.T)
            near[ids[at : at + CHUNK_ROWS, None] == others[None, :]] = np.inf
            slack = 4e-9 + 1e-12 * (own[:, 0] + square.max())
            bound = np.partition(near, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1] + slack
            for i, q, x, most in zip(ids[at : at + CHUNK_ROWS], part, near, bound, strict=True):
                some = np.flatnonzero(x <= most) if np.isfinite(most) else np.arange(len(b))
                d = np.round(((b[some] - q) ** 2).sum(axis=1), 9)
                best = some[np.lexsort((others[some], np.where(others[some] == i, np.inf, d)))[:k]]
                far = dict(zip(some.tolist(), d.tolist(), strict=True))
                rows += [(int(i), int(others[j]), far[j]) for j in best.tolist() if others[j] != i]
        return pa.table([pa.array([r[c] for r in rows], _NEAR.field(c).type) for c in range(3)], _NEAR)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, by: list[str] | None = None, block_rows: int = BLOCK_ROWS, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """(id, other, d): each query's k nearest vectors by squared distance (nine digits, ties to the smaller id), itself left out;
    with `by` among those that agree in these columns. Queries are a stated set; each block of them meets each block of vectors.

    A row is copied for each block that it meets. There are as many blocks as the largest group of `by` needs, and queries meet
    `round_blocks` blocks of vectors at once; where there are more, rounds follow each other and each one's best are written, so that
    the copies' room grows with the rows and not with their square."""
    by = by or []
    most = lambda x: x.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    n, m = (max(1, -(-most(x) // block_rows)) for x in (vectors, queries))

    def met(first: int, last: int) -> DataFrame:
        blocks = lambda at, end, name: F.explode(F.sequence(F.lit(at), F.lit(end))).alias(name)
        a = queries.select("id", "v", *by, F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias("x"), blocks(first, last, "y"))
        b = vectors.withColumn("y", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).where(F.col("y").between(first, last))
        b = b.select(F.col("id").alias("other"), "v", *by, blocks(0, m - 1, "x"), "y")
        b = b.select(*[F.col(c).alias(c) for c in b.columns])
        return a.groupBy("x", "y", *by).cogroup(b.groupBy("x", "y", *by)).applyInArrow(_nearest(k), "id long, other long, d double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
        return found.withColumn("k", rank).where(F.col("k") <= k)

    if n <= round_blocks:
        return best(met(0, n - 1))
    rounds = [saved(best(met(at, min(at + round_blocks, n) - 1)).drop("k"), "near") for at in range(0, n, round_blocks)]
    return best(reduce(DataFrame.union, rounds))


def label_profile(rows: DataFrame, query: Column, k: int) -> DataFrame:
    """(id, label, n): labels among the k nearest vectors of each row that `query` selects."""
    found = nearest(rows.where(query), rows, k)
    labels = rows.select(F.col("id").alias("other"), "label")
    return found.join(labels, "other").groupBy("id", "label").agg(F.count("*").alias("n"))


def smote(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(label, id, copy, v): new vectors that bring each label up to the size of the largest.

    Each row of a smaller label gets its share of new ones; each lies between the row and one of its k nearest of the
    same label, which one and how far on by md5 of seed, id and copy.
    """
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    need = n.join(F.broadcast(most)).where("n < most").select("label", "n", (F.col("most") - F.col("n")).alias("need"))
    small = rows.join(F.broadcast(need), "label")
    bucket = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 3)
    small = small.withColumn("bucket", bucket)
    count = small.groupBy("label", "bucket").agg(F.count("*").alias("c"))
    before = count.select("label", "bucket", (F.sum("c").over(Window.partitionBy("label").orderBy("bucket")) - F.col("c")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("id"))
    small = small.withColumn("own", rank).join(before, ["label", "bucket"]).withColumn("place", F.col("before") + F.col("own") - 1)
    share = F.floor(F.col("need") / F.col("n")) + (F.col("place") < F.col("need") % F.col("n")).cast("long")
    new = small.withColumn("share", share).where("share > 0").select("label", "id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share"))).alias("copy"))
    near = nearest(small.select("id", "label", "v"), small.select("id", "label", "v"), k, by=["label"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "other"))).alias("near"))
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col("id").cast("string"), F.col("copy").cast("string"))), 1, 6), 16, 10).cast("long")
    new = new.join(near, "id").withColumn("other", F.element_at("near", (draw("n") % F.size("near") + 1).cast("int"))["other"])
    to = rows.select(F.col("id").alias("other"), F.col("v").alias("w"))
    gap = draw("g") / float(16**6)
    return new.withColumn("gap", gap).join(to, "other").select("label", "id", "copy", F.zip_with("v", "w", lambda a, b: F.round(a + (b - a) * F.col("gap"), 6)).alias("v"))
