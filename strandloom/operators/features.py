"""Feature tables: long (id, feature, value) rows, their preparation, resampling and ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.sequences import md5_key, read


def feature_table(spark, sf_dir: str, dims: int | None = None) -> DataFrame:
    """(id, label, feature, value) from the embeddings: one row for each component."""
    e = read(spark, sf_dir, "embeddings")
    vector = F.slice("embedding", 1, dims) if dims else F.col("embedding")
    long = e.select(F.col("vec_id").alias("id"), "label", F.posexplode(vector).alias("pos", "value"))
    return long.select("id", "label", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("feature"), F.col("value").cast("double").alias("value"))


def standard_scale(x: DataFrame) -> DataFrame:
    """(value - mean) / population deviation of each feature; a constant feature is only centred."""
    stats = x.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return x.join(F.broadcast(stats), "feature").select("id", "feature", F.round((F.col("value") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 6).alias("value"))


def minmax_scale(x: DataFrame) -> DataFrame:
    stats = x.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return x.join(F.broadcast(stats), "feature").select("id", "feature", F.round(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), 6).alias("value"))


def impute_mean(x: DataFrame) -> DataFrame:
    """Missing values become their feature's mean over the others."""
    stats = x.groupBy("feature").agg(F.avg("value").alias("m"))
    return x.join(F.broadcast(stats), "feature").select("id", "feature", F.round(F.coalesce("value", "m"), 6).alias("value"))


def undersample(rows: DataFrame, seed: int, key: str = "seq_id") -> DataFrame:
    """As many rows of each label as the rarest has, by pseudo-random order.

    Each label's threshold is found by its order keys' prefix counts, so no task sorts a whole class.
    """
    dealt = rows.withColumn("order", md5_key(seed, key)).withColumn("bucket", F.substring("order", 1, 3))
    counts = dealt.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    total = counts.groupBy("label").agg(F.sum("n").alias("c")).agg(F.min("c").alias("least"))
    before = counts.select("label", "bucket", (F.sum("n").over(Window.partitionBy("label").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("order", key))
    ranked = dealt.withColumn("rank", rank).join(before, ["label", "bucket"]).join(F.broadcast(total))
    return ranked.where(F.col("before") + F.col("rank") <= F.col("least")).select(*rows.columns)


def pearson_pairs(x: DataFrame) -> DataFrame:
    """(f1, f2, c): correlation of each unordered pair of features over the ids that have both.

    Values are centred first; an id's row of values meets others in a task, where products of whole matrices are summed, so that a row for
    each pair and batch is shuffled instead of one for each pair and id. Pairs without two values or without variance are null.
    """
    mean = x.groupBy("feature").agg(F.avg("value").alias("m"))
    rows = x.where("value is not null").join(F.broadcast(mean), "feature").groupBy("id").agg(F.collect_list(F.struct("feature", (F.col("value") - F.col("m")).alias("v"))).alias("row"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            names, which = np.unique(np.array(flat.field("feature").to_pylist(), object).astype(str), return_inverse=True)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            v, has = np.zeros((len(lists), len(names))), np.zeros((len(lists), len(names)))
            v[row, which], has[row, which] = flat.field("v").to_numpy(zero_copy_only=False), 1.0
            a, b = np.triu_indices(len(names), 1)
            sums = (has.T @ has, v.T @ has, has.T @ v, (v * v).T @ has, has.T @ (v * v), v.T @ v)
            yield pa.RecordBatch.from_arrays([pa.array(names[a].tolist(), pa.string()), pa.array(names[b].tolist(), pa.string()), *(pa.array(s[a, b]) for s in sums)], ["f1", "f2", *"nabcde"])

    part = rows.select("row").mapInArrow(products, "f1 string, f2 string, " + ", ".join(f"{c} double" for c in "nabcde"))
    n, a, b, c, d, e = (F.sum(k) for k in "nabcde")
    spread = (c - a * a / n) * (d - b * b / n)
    return part.groupBy("f1", "f2").agg(F.when((n > 1) & (spread > 0), F.round((e - a * b / n) / F.sqrt(spread), 6)).alias("c"))


def average_rank(x: DataFrame) -> DataFrame:
    """Replaces each feature's values by their ranks, ties by the mean rank: counts of equal values are summed up."""
    n = x.groupBy("feature", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("feature").orderBy("value")
    ranks = n.select("feature", "value", (F.sum("n").over(w) - (F.col("n") - 1) / 2.0).alias("r"))
    return x.join(ranks, ["feature", "value"]).select("id", "feature", F.col("r").alias("value"))


def histogram(x: DataFrame, bins: int, first: str) -> DataFrame:
    """(label, bin, n) of one feature's values: equal bins over the range of label `first`; values outside are left out."""
    r = x.where(F.col("label") == first).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    inside = x.join(F.broadcast(r)).where("value between lo and hi")
    return inside.groupBy("label", F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
