"""Models: fitted on training rows only, stored and applied, better than chance where features tell the class."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import models as M
from strandloom.operators import tables as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(240):
        label = i % 3
        x = [label + rng.gauss(0, 0.3), rng.gauss(0, 1), None if i % 11 == 0 else rng.gauss(label, 2)]
        if i % 13 == 0:
            x[1] = float("inf")
        out.append((i, x, label, i % 4))
    return spark.createDataFrame(out, "id long, features array<double>, label int, fold int")


def test_means_leave_out_what_is_missing(spark):
    x = spark.createDataFrame([([1.0, None, float("nan")],), ([3.0, 4.0, float("inf")],)], "features array<double>")
    means = M.column_means(x)
    assert means.first().means == [2.0, 4.0, 0.0]
    assert [r.features for r in M.imputed(x, means).collect()] == [[1.0, 4.0, 0.0], [3.0, 4.0, 0.0]]
    assert M.column_means(x.limit(0)).first().means == [0.0]


def test_fit_store_apply(spark, rows, tmp_path):
    fitted = M.fit(rows.where("fold > 0"))
    M.store(fitted, str(tmp_path / "bundle"))
    new = rows.where("fold = 0").drop("label")
    here, there = (M.apply(new, f).orderBy("id").collect() for f in (fitted, M.load(spark, str(tmp_path / "bundle"))))
    assert here == there and len(here) == 60
    right = M.apply(rows.where("fold = 0"), fitted).where("pred = label").count()
    assert right > 50
    weights = M.importances(spark, fitted)
    assert weights.first().feature == "f0" and M.above(spark, weights, 0.5) == [0]
    drop = {r.feature: r["drop"] for r in M.permutation_importance(rows.where("fold = 0"), fitted, [0, 1]).collect()}
    assert drop["f0"] > 0.3 > drop["f1"]


def test_folds_and_components(rows):
    p = M.cross_validated(rows, 4, "logistic")
    assert p.count() == 240 and p.where("real = pred").count() > 200
    assert M.fold_metrics(p, 4).where("accuracy > 0.8").count() == 4
    pc = M.principal_components(rows, 2)
    assert pc.count() == 240 and abs(pc.agg(F.sum(F.col("pc")[0])).first()[0]) < 1e-6


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "a int, b double, key int")
    assert T.key_last(df, "a").columns == ["b", "key", "a"]
    assert T.seen_columns(df, ["b", "z"]).first() == (2.0, None)
    twice = df.select("a", "b", F.col("key").alias("a"))
    assert T.distinct_columns(twice).first().asDict() == {"a": 1, "b": 2.0}
    codes = T.ordinal_fit(spark.createDataFrame([("x",), ("y",), (None,)], "v string"), "v")
    assert [r.v for r in T.ordinal_apply(spark.createDataFrame([("y",), ("new",), (None,)], "v string"), "v", codes).collect()] == [1, -1, -1]
