"""Sequence files: FASTA in and out, and per-position profile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fasta_scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, ord, name, seq) of each record: ">" begins one, its name is the first token of its line, further lines
    are its sequence without white space, in upper case; the file's stem is the label.

    Records are split by the reader, so files are read in parallel; ord counts a file's records in their order.
    """
    raw = spark.read.option("lineSep", ">").text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    parts = F.split("value", "\n", 2)
    name = F.split(F.trim(F.get(parts, F.lit(0))), r"\s+")[0]
    seq = F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", ""))
    rows = raw.where(F.trim("value") != "").select("file", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("label"), "place", name.alias("name"), seq.alias("seq"))
    order = F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1
    return rows.select("file", "label", order.cast("long").alias("ord"), "name", "seq")


def quarantine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that are whole, and those without a name or a sequence."""
    bad = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("seq", F.lit("")) == "")
    return records.where(~bad), records.where(bad)


def write_fasta(records: DataFrame, path: str) -> None:
    """Writes (name, seq) as FASTA text, a record a row."""
    records.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def csv_without_repeated_headers(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV feature file read as strings; header lines that appending has repeated are dropped, other columns become double."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    rows = rows.where(F.col(key) != key)
    return rows.select(*[F.col(c) if c in (key, "label") else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in rows.columns])


def write_features(table: DataFrame, path: str, names: dict[str, str], compression: str = "gzip") -> None:
    """Writes a feature table as compressed CSV with display names."""
    table.withColumnsRenamed(names).write.option("header", True).option("compression", compression).csv(path)


def write_libsvm(table: DataFrame, label: str, features: list[str], path: str) -> None:
    """Writes label and features as libsvm text, numbered from 1."""
    from pyspark.ml.feature import VectorAssembler

    VectorAssembler(inputCols=features, outputCol="features").transform(table).select(F.col(label).cast("double").alias("label"), "features").write.format("libsvm").save(path)
