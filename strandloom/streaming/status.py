"""Streams: the latest status of each job, and scores for new sequence files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_status(log: DataFrame, late: str = "1 day") -> DataFrame:
    """The last event of each user_id of a streamed log (event_id, ts, user_id, event_type), for update mode."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return log.withWatermark("ts", late).groupBy("user_id").agg(last.alias("x"), F.min("ts").alias("first")).select("user_id", F.col("x.event_type").alias("status"), F.col("x.ts").alias("at"), (F.unix_timestamp("x.ts") - F.unix_timestamp("first")).alias("seconds"))


def score_new_files(spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Reads FASTA files as they arrive, scores each batch of (name, seq) and appends the result; resumes from the checkpoint."""
    raw = spark.readStream.option("lineSep", ">").text(path)
    parts = F.split("value", "\n", 2)
    seq = F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", ""))
    rows = raw.where(F.trim("value") != "").select(F.split(F.trim(F.get(parts, F.lit(0))), r"\s+")[0].alias("name"), seq.alias("seq"))
    return rows.writeStream.foreachBatch(lambda df, i: score(df).write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
