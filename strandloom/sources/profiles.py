"""Files of numbers that go with sequences: per-residue profiles, property tables, and stored descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of the residue columns in position-specific scoring matrices; fixed values.
MATRIX_ORDER = "ARNDCQEGHILKMFPSTWYV"


def profile_scan(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    """(seq_id, pos, residue, track, value string) of per-residue files, one protein a file, its stem the seq_id.

    A line of a residue begins with its position and one letter; `columns` names the fields, from 0, that are read of it (the second
    one, the letter, is 1). Headers, footers and other lines are left out, and so are fields that a line lacks. This reads
    scoring matrices, and predictions of secondary structure, disorder and accessibility, in parallel and whatever their length.
    """
    raw = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("seq_id"), F.split(F.trim("value"), r"\s+").alias("f"))
    lines = raw.where(F.get("f", F.lit(0)).rlike("^[0-9]+$") & F.get("f", F.lit(1)).rlike("^[A-Za-z]$"))
    tracks = F.array(*[F.struct(F.lit(name).alias("track"), F.get("f", F.lit(i)).alias("value")) for name, i in columns.items()])
    rows = lines.select("seq_id", F.col("f")[0].cast("int").alias("pos"), F.upper(F.col("f")[1]).alias("residue"), F.explode(tracks).alias("x"))
    return rows.select("seq_id", "pos", "residue", "x.track", "x.value").where("value is not null")


def matrix_scan(spark: SparkSession, path: str) -> DataFrame:
    """profile_scan of scoring matrices: a track for each residue, value double."""
    rows = profile_scan(spark, path, {c: i for i, c in enumerate(MATRIX_ORDER, 2)})
    return rows.withColumn("value", F.expr("try_cast(value as double)")).where("value is not null")


def property_table_scan(spark: SparkSession, path: str, kmers: list[str]) -> DataFrame:
    """(kmer, property, value) of text files with a line for each property: its name, and after tabs or commas a value for each k-mer in
    the order given. Lines with another number of values, or without numbers, raise an error when they are read."""
    fields = F.split("value", r"\s*[\t,]\s*")
    rows = spark.read.text(path).where(F.trim("value") != "").select(fields[0].alias("property"), F.slice(fields, 2, 1 << 20).alias("values"))
    right = F.size("values") == len(kmers)
    values = F.when(right, F.col("values")).otherwise(F.raise_error(F.concat(F.lit("wrong number of values: "), F.col("property"))))
    names = F.array(*map(F.lit, kmers))
    return rows.select("property", F.explode(F.arrays_zip(names.alias("kmer"), values.alias("value"))).alias("x")).select("x.kmer", "property", F.col("x.value").cast("double").alias("value"))


def csv_scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, read by a schema; a value that does not fit it stops the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def append_features(table: DataFrame, path: str) -> None:
    """Adds a feature table's rows to CSV files that have the same columns; each file has its own header."""
    table.write.mode("append").option("header", True).csv(path)


def store_descriptors(long: DataFrame, path: str) -> None:
    """Writes (seq_id, descriptor, feature, value) by descriptor; those that are written replace what is there of them, and others stay."""
    near = long.repartition("descriptor", F.pmod(F.xxhash64("seq_id"), F.lit(16)))
    near.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("descriptor").parquet(path)


def load_descriptors(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Stored descriptors, all or the named ones; of the others no file is read."""
    rows = spark.read.parquet(path)
    return rows if names is None else rows.where(F.col("descriptor").isin(names))


def cached(spark: SparkSession, path: str, makers: dict) -> DataFrame:
    """The named descriptors, each made by its function (no arguments, a DataFrame (seq_id, feature, value)) only if none is stored."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, make in makers.items():
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/descriptor={name}")):
            store_descriptors(make().select("seq_id", F.lit(name).alias("descriptor"), "feature", "value"), path)
    return load_descriptors(spark, path, list(makers))
