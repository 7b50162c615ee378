"""Models over feature arrays: fitted on training rows only, evaluated by folds, stored, and applied to new rows."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import evaluation as E

TREES = 50
DEPTH = 8
ROUNDS = 20  # of boosting

CLASSIFIERS = {
    "forest": lambda seed, trees, depth: RandomForestClassifier(labelCol="label", featuresCol="scaled", numTrees=trees or TREES, maxDepth=depth or DEPTH, seed=seed),
    "boosted": lambda seed, trees, depth: OneVsRest(classifier=GBTClassifier(labelCol="label", featuresCol="scaled", maxIter=trees or ROUNDS, maxDepth=depth or 5, seed=seed), labelCol="label", featuresCol="scaled"),
    "logistic": lambda seed, trees, depth: LogisticRegression(labelCol="label", featuresCol="scaled", maxIter=50),
}
REGRESSORS = {
    "forest": lambda seed, trees, depth: RandomForestRegressor(labelCol="label", featuresCol="scaled", numTrees=trees or TREES, maxDepth=depth or DEPTH, seed=seed),
    "boosted": lambda seed, trees, depth: GBTRegressor(labelCol="label", featuresCol="scaled", maxIter=trees or ROUNDS, maxDepth=depth or 5, seed=seed),
    "linear": lambda seed, trees, depth: LinearRegression(labelCol="label", featuresCol="scaled", maxIter=50),
}


def column_means(train: DataFrame) -> DataFrame:
    """One row (means): the mean of each place of `features` (array<double>) over its finite values, 0 without any."""
    x = train.select(F.posexplode("features").alias("pos", "x")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    width = train.agg(F.max(F.size("features")).alias("width"))
    means = x.groupBy("pos").agg(F.avg("x").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "m"))).alias("by"))  # a row for each feature
    return means.join(width).select(F.transform(F.sequence(F.lit(0), F.coalesce("width", F.lit(1)) - 1), lambda i: F.coalesce(F.col("by")[i], F.lit(0.0))).alias("means"))


def imputed(rows: DataFrame, means: DataFrame) -> DataFrame:
    """rows with missing and non-finite places of `features` replaced by the training means, which also give the width."""
    fill = F.transform("means", lambda m, i: F.when(F.get("features", i).isNull() | F.isnan(F.get("features", i)) | (F.abs(F.get("features", i)) == float("inf")), m).otherwise(F.get("features", i)))
    return rows.join(F.broadcast(means)).withColumn("features", fill).drop("means")


def fit(train: DataFrame, learner: str = "forest", kind: str = "classifier", seed: int = 63, trees: int | None = None, depth: int | None = None) -> tuple[DataFrame, PipelineModel]:
    """(means, model) of train (features, label): imputation, standard scaling and the learner see training rows only. trees and depth
    are those of forests and boosted trees."""
    means = column_means(train).persist()
    learn = (CLASSIFIERS if kind == "classifier" else REGRESSORS)[learner](seed, trees, depth)
    stages = [StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True), learn]
    rows = imputed(train, means).select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label")).persist()
    try:
        return means, Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def apply(rows: DataFrame, fitted: tuple[DataFrame, PipelineModel]) -> DataFrame:
    """rows with `pred` and, where the learner has them, `probability` (array<double>)."""
    means, model = fitted
    out = model.transform(imputed(rows, means).withColumn("vector", array_to_vector("features")))
    extra = [vector_to_array("probability").alias("probability")] if "probability" in out.columns else []
    return out.select(*rows.columns, F.col("prediction").alias("pred"), *extra)


def store(fitted: tuple[DataFrame, PipelineModel], path: str) -> None:
    fitted[0].write.mode("overwrite").parquet(f"{path}/means")
    fitted[1].write().overwrite().save(f"{path}/model")


def load(spark, path: str) -> tuple[DataFrame, PipelineModel]:
    return spark.read.parquet(f"{path}/means"), PipelineModel.load(f"{path}/model")


def cross_validated(rows: DataFrame, folds: int = 5, learner: str = "forest", seed: int = 63, kind: str = "classifier", **settings) -> DataFrame:
    """rows (id, features, label, fold) with out-of-fold predictions (id, fold, real, pred): a fit for each of the few folds, run at
    the same time."""

    def one(k: int) -> DataFrame:
        found = apply(rows.where(F.col("fold") == k), fit(rows.where(F.col("fold") != k), learner, kind, seed, **settings))
        pred = F.col("pred").cast("int") if kind == "classifier" else F.col("pred")
        return found.select("id", "fold", F.col("label").alias("real"), pred.alias("pred"))

    with ThreadPool(folds) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(folds)))


def fold_metrics(predictions: DataFrame, folds: int) -> DataFrame:
    """(fold, accuracy, ...): the summary of each fold's predictions."""
    return reduce(DataFrame.unionByName, [E.summary(predictions.where(F.col("fold") == k)).withColumn("fold", F.lit(k)) for k in range(folds)])


def importances(spark, fitted: tuple[DataFrame, PipelineModel]) -> DataFrame:
    """(feature, importance) of a forest or boosted trees, largest first; a row for each feature."""
    weights = fitted[1].stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f"f{i}", float(w)) for i, w in enumerate(weights)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(rows: DataFrame, fitted: tuple[DataFrame, PipelineModel], features: list[int], seed: int = 42) -> DataFrame:
    """(feature, drop) of rows (id, features, label): how much accuracy falls when one feature's values are dealt to other rows."""
    def accuracy(x: DataFrame) -> DataFrame:
        return apply(x, fitted).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))

    from strandloom.operators.tables import shuffled

    def replaced(place: int):
        return F.transform("features", lambda x, k: F.when(k == place, F.col("value")).otherwise(x))

    whole = accuracy(rows).withColumnRenamed("accuracy", "whole")
    at = shuffled(rows, "id", seed)
    parts = []
    for i in features:
        # the row at a place gets the value of the row at the same place of another order
        values = shuffled(rows.select("id", F.get("features", F.lit(i)).alias("value")), "id", seed + 1 + i).select("place", "value")
        swapped = at.join(values, "place").withColumn("features", replaced(i)).select(*rows.columns)
        parts.append(accuracy(swapped).join(whole).select(F.lit(f"f{i}").alias("feature"), (F.col("whole") - F.col("accuracy")).alias("drop")))
    return reduce(DataFrame.unionByName, parts)


def above(spark, weights: DataFrame, least: float) -> list[int]:
    """Places of the features whose importance reaches the threshold: a choice of columns, so it comes to the driver."""
    return sorted(int(r["feature"][1:]) for r in weights.where(F.col("importance") >= least).collect())


def principal_components(rows: DataFrame, k: int) -> DataFrame:
    """(id, pc): the first k principal components of standardised features."""
    x = imputed(rows, column_means(rows)).select("id", array_to_vector("features").alias("vector"))
    model = Pipeline(stages=[StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="pc")]).fit(x)
    return model.transform(x).select("id", vector_to_array("pc").alias("pc"))
