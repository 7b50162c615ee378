"""Searches: the group that decides is found, training rows alone are resampled, thresholds drop what does not help."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import search as S

FEW = {"trees": 8, "depth": 4}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for i in range(180):
        label = int(i % 3 == 0)
        x = [rng.gauss(0, 1), rng.gauss(0, 1), label * 3 + rng.gauss(0, 0.4), None if i % 17 == 0 else rng.gauss(0, 1)]
        out.append((i, x, label, (i // 3) % 3))
    return spark.createDataFrame(out, "id long, features array<double>, label int, fold int").repartition(2)


def test_group_search_finds_the_deciding_group(spark, rows):
    groups = {"noise": [0, 1], "signal": [2], "more": [3]}
    best, trials = S.group_search(rows, groups, ("logistic",), trials=5, folds=3, parallel=2, settings=FEW)
    assert "signal" in best.groups and best.score > 0.9 and len(trials) == len({t.groups for t in trials}) == 5
    table = S.trial_table(spark, trials)
    assert table.count() == 5 and table.where("state = 'done'").agg(F.max("score")).first()[0] == best.score
    lacking = [t for t in trials if "signal" not in t.groups]
    assert all(t.state == "hopeless" or t.score < best.score for t in lacking)
    assert S.presence(spark, groups, best).first()["signal"] == 1
    again = S.proposals(groups, ("logistic",), 3, 63, [], None)
    assert again == S.proposals(groups, ("logistic",), 3, 63, [], None) and again[0].groups == ("more", "noise", "signal")
    model = S.refit(rows, best, settings=FEW)
    from strandloom.operators import models as M

    assert M.apply(S.chosen(rows, best.columns), model).where("pred = label").count() > 165


def test_trials_end_early(rows):
    bad = S.evaluate(rows, S.Trial(0, columns=(0,), learner="none of them"), 3)
    assert (bad.state, bad.folds, bad.note) == ("failed", 0, "KeyError")
    slow = S.evaluate(rows, S.Trial(1, columns=(0, 1), learner="logistic"), 3, to_beat=lambda: 0.99, settings=FEW)
    assert slow.state == "hopeless" and slow.folds < 3 and slow.score is None
    assert S.best_of([bad, slow]) is None


def test_training_rows_alone_are_resampled(rows):
    held = {r.id for r in rows.where("fold = 1").collect()}
    for how, least in (("none", 40), ("under", 40), ("smote", 80)):
        train = S.training_rows(rows, 1, how, 5).collect()
        assert not held & {r.id for r in train if r.id is not None}
        count = {y: sum(r.label == y for r in train) for y in (0, 1)}
        assert min(count.values()) == least and (how == "none" or count[0] == count[1])
        assert (how == "smote") == any(r.id is None for r in train)
        if how == "smote":
            assert all(r.label == 1 and 1 < r.features[2] < 5 and None not in r.features for r in train if r.id is None)
    with pytest.raises(ValueError, match="no resampler"):
        S.resampled(rows, "twice", 1)


def test_pick_resampler_and_algorithm(rows):
    best, trials = S.pick_resampler(rows.withColumn("fold", F.col("fold") % 2), "logistic", settings=FEW)
    assert best.resample in ("smote", "under") and {t.resample for t in trials} == {"smote", "under"} and all(t.state == "done" for t in trials)
    balanced = rows.where("label = 1 or id % 3 = 1")
    assert S.pick_resampler(balanced, "logistic") == (S.Trial(0, learner="logistic", state="balanced"), [])
    best, trials = S.pick_algorithm(rows.withColumn("fold", F.col("fold") % 2), ("logistic", "forest"), settings=FEW)
    assert best.score == max(t.score for t in trials) > 0.9


def test_threshold_search(rows):
    least, columns, trials = S.threshold_search(rows, folds=3, most=2, settings=FEW)
    assert 2 in columns and all(t.state == "done" for t in trials[:1]) and trials[0].columns == (0, 1, 2, 3)
    best = max(t.score for t in trials if t.score is not None)
    assert least == max(float(t.note) for t in trials if t.score == best)
    assert S.thresholds([0.1, 0.2, 0.2, 0.7], 5, 1) == [0.1, 0.2] and len(S.thresholds([i / 10 for i in range(10)], 3, 1)) == 3


def test_regressors(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        x = [rng.uniform(-1, 1), rng.uniform(-1, 1)]
        rows.append((i, x, 3 * x[0] - x[1] + rng.gauss(0, 0.05), i % 2))
    rows = spark.createDataFrame(rows, "id long, features array<double>, label double, fold int")
    best, trials = S.pick_algorithm(rows, ("linear", "forest", "boosted"), score="r2", kind="regressor", settings=FEW)
    assert best.learner == "linear" and best.score > 0.98 and all(t.state == "done" and t.score > 0.5 for t in trials)
    best, _ = S.group_search(rows, {"first": [0], "second": [1]}, ("linear",), trials=3, folds=2, score="r2", kind="regressor")
    assert best.groups == ("first", "second")
