"""Sequence tables: cleaning, validation, filters, duplicates and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUCLEOTIDES = "ACGT"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def letters(c: Column) -> Column:
    """ASCII letters in upper case; other characters go."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


def clean_dna(c: Column) -> Column:
    """Nucleotides in upper case, U as T; other characters go."""
    return F.translate(F.regexp_replace(letters(c), "[^ATGCU]", ""), "U", "T")


def clean_protein(c: Column) -> Column:
    """The twenty amino acids in upper case; other characters go."""
    return F.regexp_replace(letters(c), f"[^{AMINO_ACIDS}]", "")


def sequence_table(spark: SparkSession, sf_dir: str, kind: str = "dna") -> DataFrame:
    """(seq_id, label, seq): the documents' texts read as nucleotide or protein sequences, language as the class."""
    clean = clean_dna if kind == "dna" else clean_protein
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("label"), clean(F.col("text")).alias("seq"))


def md5_key(seed: int, column: str) -> Column:
    """Order key that any engine can recompute: md5 of "seed:id"."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def alphabet_violations(s: DataFrame, alphabet: str) -> DataFrame:
    """Sequences with a character outside the alphabet, and the first such character."""
    bad = F.regexp_extract("seq", f"([^{alphabet}])", 1)
    return s.select("seq_id", bad.alias("bad_char")).where("bad_char <> ''")


def dedupe_sequences(s: DataFrame) -> DataFrame:
    """One row for each distinct sequence: its least seq_id, and how many rows it had; map-side combined, so a common
    sequence is no hot group."""
    return s.groupBy("seq").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("copies")).select("seq_id", "copies", F.length("seq").alias("len"))


def split_tag(s: DataFrame, test: DataFrame) -> DataFrame:
    """train or test by membership of seq_id in `test`."""
    flag = test.select("seq_id", F.lit(True).alias("in_test")).distinct()
    return s.join(flag, "seq_id", "left").withColumn("split", F.when(F.col("in_test"), "test").otherwise("train")).drop("in_test")


def ranked(rows: DataFrame, first: str, then: str, by: str | None = None, name: str = "rank", cuts: int = 1024) -> DataFrame:
    """rows with their number, from 1, in the order of `first` (numbers or times, nulls last) and `then`, within each value of `by` if given.

    `first` is cut at `cuts` approximate quantiles of all rows; rows are numbered within what lies between two cuts and the counts
    before are added, so that no window holds more than that of a value of `by`. Rows of one value of `first` are sorted together;
    those equal in both columns are numbered in any order. Null values of `by` are a group of their own.
    """
    from pyspark.ml.feature import Bucketizer

    kind, c = rows.schema[first].dataType.typeName(), F.col(first)
    day = F.unix_date(F.to_date(c)).cast("double")
    if kind == "timestamp_ntz":
        at = day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)  # whatever the session's time zone
    else:
        at = day if kind == "date" else c.cast("double")
    found = rows.agg(F.percentile_approx(at, [i / cuts for i in range(1, cuts)], 4 * cuts)).first()[0]
    inner = sorted({x for x in found or [] if x == x})
    dealt = rows.withColumn("_at", F.coalesce(at, F.lit(float("nan"))))  # the last part has what is no number
    if inner:
        dealt = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_at", outputCol="_part", handleInvalid="keep").transform(dealt)
    else:
        dealt = dealt.withColumn("_part", F.lit(0.0))
    dealt = dealt.withColumn("_by", F.col(by) if by else F.lit(0))
    count = dealt.groupBy("_by", "_part").agg(F.count("*").alias("n"))
    before = count.select(F.col("_by").alias("_b"), F.col("_part").alias("_p"), (F.sum("n").over(Window.partitionBy("_by").orderBy("_part")) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_by", "_part").orderBy(F.col(first).asc_nulls_last(), then))
    numbered = dealt.withColumn("_own", own).join(before, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")))
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))


def folds(rows: DataFrame, k: int, seed: int, by: str | None = None, key: str = "seq_id") -> DataFrame:
    """Fold 0 to k-1 by pseudo-random order, within each value of `by` if given; sizes differ by one at most.

    Rows are ranked in two steps, within hash buckets and then over the buckets' counts, so that no window holds all rows
    of a class.
    """
    group = [by] if by else []
    h = md5_key(seed, key)
    dealt = rows.withColumn("order", h).withColumn("bucket", F.substring("order", 1, 3))
    count = dealt.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    before = count.select(*group, "bucket", (F.sum("n").over(Window.partitionBy(*group).orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy("order", key))
    fold = ((F.col("before") + F.col("rank") - 1) % k).cast("int")
    return dealt.withColumn("rank", rank).join(before, [*group, "bucket"]).select(*rows.columns, fold.alias("fold"))
