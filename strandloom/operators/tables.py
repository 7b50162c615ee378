"""Tables around models: columns, aligned joins, cross-tabs, catalogues of runs, checks and encoders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.sequences import md5_key

TOTALS = ("all", "total", "real")  # labels of margins


def key_last(df: DataFrame, key: str, without: tuple[str, ...] = ()) -> DataFrame:
    """The columns in their order but those left out, the key as the last one."""
    return df.select(*[c for c in df.columns if c != key and c not in without], key)


def seen_columns(df: DataFrame, trained: list[str]) -> DataFrame:
    """The columns that a model was fitted on, in its order; those that df lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in trained])


def distinct_columns(df: DataFrame) -> DataFrame:
    """Of columns with the same name the first."""
    names = [f"c{i}" for i in range(len(df.columns))]
    first = {c: n for n, c in reversed(list(zip(names, df.columns, strict=True)))}
    return df.toDF(*names).select(*[F.col(first[c]).alias(c) for c in dict.fromkeys(df.columns)])


def align(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of any number of tables on one key, which comes last; other columns need distinct names."""
    return key_last(reduce(lambda a, b: a.join(b, key, "full_outer"), tables), key)


def side_by_side(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows that all tables have, beside each other by key: never by position."""
    return reduce(lambda a, b: a.join(b, key), tables)


def without_totals(crosstab: DataFrame, *labels: str) -> DataFrame:
    """Rows of a long cross-tab whose labels are no margins, in any case of letters."""
    return crosstab.where(reduce(lambda a, b: a & b, [~F.lower(F.col(c).cast("string")).isin(*TOTALS) for c in labels]))


def square(crosstab: DataFrame, row: str, column: str) -> DataFrame:
    """Rows of a long cross-tab whose two labels both occur as row and as column labels."""
    both = crosstab.select(F.col(row).alias("both")).intersect(crosstab.select(F.col(column)))
    kept = crosstab.join(F.broadcast(both), F.col(row) == F.col("both"), "left_semi")
    return kept.join(F.broadcast(both), F.col(column) == F.col("both"), "left_semi")


def percent(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c) * 100 for c in columns})


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Infinite values and NaN of the columns become null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in columns})


def null_and_infinite(df: DataFrame) -> DataFrame:
    """(column, nulls, infinite): how many values of each column are null or NaN, and infinite; one pass over the table."""
    number = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def counts(c: str) -> Column:
        bad = F.col(c).isNull() | (F.isnan(c) if c in number else F.lit(False))
        inf = F.abs(c) == float("inf") if c in number else F.lit(False)
        return F.struct(F.lit(c).alias("column"), F.count(F.when(bad, 1)).alias("nulls"), F.count(F.when(inf, 1)).alias("infinite"))

    return df.agg(F.array(*map(counts, df.columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def labels_of(names: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows of names with their label and, in each row, how many names have none: a caller can refuse the table if it is not 0."""
    found = names.join(labels, key, "left")
    missing = found.agg(F.count(F.when(F.col("label").isNull(), 1)).alias("missing"))
    return found.join(F.broadcast(missing))


def lookup(models: DataFrame, rows: DataFrame) -> DataFrame:
    """For each model (model, number) the row (name, ...) whose name ends with that number as a whole; else one that holds its
    digits; ties to the first name. Names' numbers are taken out once, so the first rule is an equi-join."""
    at = rows.withColumn("n", F.regexp_extract("name", r"(\d+)$", 1)).where("n <> ''")
    exact = models.join(at, F.col("number").cast("string") == F.col("n")).select("model", F.lit(0).alias("rule"), "name")
    # the digits of a longer number hold those of a shorter one: all runs of its digits are keys
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.length("n")), lambda i: F.transform(F.sequence(F.lit(1), F.length("n") - i + 1), lambda k: F.substr("n", i, k))))
    inside = at.select("name", F.explode(F.array_distinct(runs)).alias("run"))
    loose = models.join(inside, F.col("number").cast("string") == F.col("run")).select("model", F.lit(1).alias("rule"), "name")
    return exact.unionByName(loose).groupBy("model").agg(F.min(F.struct("rule", "name")).alias("x")).select("model", "x.rule", "x.name")


def with_citations(models: DataFrame, citations: DataFrame) -> DataFrame:
    """models (model, keys: a comma list) beside each of its citations (key, text); an unknown key gets a placeholder."""
    each = models.select("model", F.explode(F.split("keys", ",")).alias("key")).withColumn("key", F.trim("key")).where("key <> ''")
    return each.join(citations, "key", "left").select("model", "key", F.coalesce("text", F.lit("Reference not available")).alias("text"))


def number_of(column: str) -> Column:
    """The number at a name's end, for orders by number instead of letters."""
    return F.regexp_extract(column, r"(\d+)$", 1).cast("long")


def best(scores: DataFrame, by: str) -> DataFrame:
    """(by, algo, score): the algorithm of the highest score, ties to the smaller place; scores: (by, place, algo, score)."""
    top = F.max(F.struct("score", (-F.col("place")).alias("order"), "algo")).alias("x")
    return scores.groupBy(by).agg(top).select(by, "x.algo", "x.score")


def ordinal_fit(train: DataFrame, column: str) -> DataFrame:
    """(value, code): the training values in order of letters, numbered from 0. Few values: classes, not identifiers."""
    return train.select(F.col(column).alias("value")).where("value is not null").distinct().select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))


def ordinal_apply(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """df with `column` as its code; a value that training did not have is -1."""
    return df.join(F.broadcast(codes), F.col(column) == F.col("value"), "left").drop("value").withColumn(column, F.coalesce("code", F.lit(-1))).drop("code")


def shuffled(df: DataFrame, key: str, seed: int, buckets: int = 256) -> DataFrame:
    """df with `place`, its rows' pseudo-random order from 0: ranks within hash buckets plus the buckets' prefix counts."""
    dealt = df.withColumn("order", md5_key(seed, key)).withColumn("bucket", F.conv(F.substring("order", 1, 4), 16, 10).cast("int") % buckets)
    n = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    before = n.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("order", key))
    return dealt.withColumn("rank", rank).join(F.broadcast(before), "bucket").select(*df.columns, (F.col("before") + F.col("rank") - 1).alias("place"))


def subsample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows, the first in pseudo-random order: the feature's own limit."""
    return df.orderBy(md5_key(seed, key), key).limit(most)


def stacked(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of all tables under each other with the table's name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(name, F.lit(k)) for k, t in tables.items()])


def collect_runs(grid: DataFrame, metrics: DataFrame, on: list[str]) -> DataFrame:
    """Every planned run with its metrics; null where its test is missing."""
    return grid.join(metrics, on, "left")


def strongest_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (f1, f2, c) whose correlation is at least so strong, the strongest first."""
    return pairs.where(F.abs("c") >= least).orderBy(F.desc(F.abs("c")), "f1", "f2")
