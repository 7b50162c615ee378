"""Searches over models: groups of features, learners, resampling and thresholds, each scored by folds of the training rows.

Rows are (id, features array<double>, label, fold). Trials are few and small to describe; they are proposed on the driver and each
runs as Spark jobs over the same cached rows, several at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import evaluation as E
from strandloom.operators import features as X
from strandloom.operators import models as M
from strandloom.operators import neighbours as N

NEIGHBOURS = 5
RESAMPLERS = ("none", "under", "smote")


def resampled(train: DataFrame, how: str, seed: int) -> DataFrame:
    """Training rows (id, features, label) with as many rows of each label: as they are ("none"), cut down to the rarest label
    ("under"), or filled up with new ones between neighbours of the same label ("smote", for which missing places take their means; new
    rows have no id)."""
    train = train.select("id", "features", "label")
    if how == "none":
        return train
    if how == "under":
        return X.undersample(train, seed, key="id")
    if how == "smote":
        whole = M.imputed(train, M.column_means(train))
        new = N.smote(whole.select("id", "label", F.col("features").alias("v")), NEIGHBOURS, seed)
        return whole.unionByName(new.select(F.lit(None).cast(train.schema["id"].dataType).alias("id"), F.col("v").alias("features"), "label"))
    raise ValueError(f"no resampler {how}")


def training_rows(rows: DataFrame, fold: int, how: str, seed: int) -> DataFrame:
    """What a model may see when `fold` is held out: resampled rows of the other folds."""
    return resampled(rows.where(F.col("fold") != fold), how, seed)


def chosen(rows: DataFrame, columns: Iterable[int] | None) -> DataFrame:
    """rows with the named places of their features alone."""
    if columns is None:
        return rows
    return rows.withColumn("features", F.array(*[F.get("features", F.lit(i)) for i in columns]))


def score_of(predictions: DataFrame, score: str) -> float:
    """balanced_accuracy, f1_weighted and the other columns of the summary, or r2, of (real, pred)."""
    table = E.regression(predictions) if score in ("mae", "mse", "rmse", "r2") else E.summary(predictions)
    found = table.first()[score]
    return float("-inf") if found is None else float(found)


@dataclass(frozen=True)
class Trial:
    """A choice to be scored: features by group or by place, learner and resampler; what became of it."""

    number: int
    groups: tuple[str, ...] = ()
    columns: tuple[int, ...] | None = None
    learner: str = "forest"
    resample: str = "none"
    state: str = "new"
    folds: int = 0
    score: float | None = None
    note: str = ""


_TRIALS = "trial int, groups array<string>, columns int, learner string, resample string, state string, folds int, score double, note string"


def trial_table(spark, trials: list[Trial]) -> DataFrame:
    """A row for each trial, in order."""
    return spark.createDataFrame([(t.number, list(t.groups), None if t.columns is None else len(t.columns), t.learner, t.resample, t.state, t.folds, t.score, t.note) for t in trials], _TRIALS)


def evaluate(rows: DataFrame, trial: Trial, folds: int, score: str = "balanced_accuracy", seed: int = 63, to_beat: Callable[[], float] = lambda: float("-inf"), columns_of: Callable[[DataFrame], Iterable[int]] | None = None, kind: str = "classifier", settings: dict | None = None) -> Trial:
    """The trial with its mean score over the folds.

    A score is at most 1, so a trial that could not reach `to_beat` with 1 in all folds to come ends as "hopeless"; one that cannot
    be fitted ends as "failed" with the error's name and does not stop the others. `columns_of` chooses columns from the training
    rows of each fold.
    """
    total, made = 0.0, []
    for k in range(folds):
        try:
            train = training_rows(rows, k, trial.resample, seed)
            if trial.resample == "smote":  # means and model read it: neighbours are found once
                train = train.persist()
                made.append(train)
            columns = trial.columns if columns_of is None else list(columns_of(train))
            if columns is not None and not columns:
                raise ValueError("no columns")
            fitted = M.fit(chosen(train, columns), trial.learner, kind, seed, **(settings or {}))
            held = M.apply(chosen(rows.where(F.col("fold") == k), columns), fitted)
            total += score_of(held.select(F.col("label").alias("real"), "pred"), score)
        except Exception as e:  # noqa: BLE001  whatever a learner cannot do is the trial's result
            return replace(trial, state="failed", folds=k, note=type(e).__name__)
        finally:
            while made:
                made.pop().unpersist()
        if (total + folds - 1 - k) / folds < to_beat():
            return replace(trial, state="hopeless", folds=k + 1)
    return replace(trial, state="done", folds=folds, score=round(total / folds, 6))


def best_of(trials: list[Trial]) -> Trial | None:
    """The trial of the highest score; of equal ones that with fewer columns, then the first."""
    done = [t for t in trials if t.state == "done"]
    return min(done, key=lambda t: (-t.score, len(t.columns or ()), t.number), default=None)


def _run(rows: DataFrame, trials: list[Trial], parallel: int, before: list[Trial] | None = None, **how) -> list[Trial]:
    """Trials at the same time; with those `before` each must be able to beat the best one so far."""
    found = list(before or [])

    def to_beat() -> float:
        best = best_of(found) if before is not None else None
        return best.score if best else float("-inf")

    def one(t: Trial) -> Trial:
        out = evaluate(rows, t, to_beat=to_beat, **how)
        found.append(out)
        return out

    with ThreadPool(parallel) as pool:
        return pool.map(one, trials, chunksize=1)


def _draw(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def proposals(groups: dict[str, list[int]], learners: tuple[str, ...], many: int, seed: int, tried: list[Trial], best: Trial | None) -> list[Trial]:
    """New trials: masks of groups drawn by md5 of seed and number or, once there is a best one, its neighbours: one group more or
    less, or another learner. Nothing is proposed twice, and no empty mask."""
    seen = {(t.groups, t.learner) for t in tried}
    out: list[Trial] = []

    def add(names: Iterable[str], learner: str) -> None:
        key = tuple(sorted(names)), learner
        if key[0] and key not in seen and len(out) < many:
            seen.add(key)
            out.append(Trial(len(tried) + len(out), key[0], tuple(i for g in key[0] for i in groups[g]), learner))

    if best is not None:
        near = [(set(best.groups) ^ {g}, best.learner) for g in groups] + [(set(best.groups), x) for x in learners if x != best.learner]
        for names, learner in sorted(near, key=lambda n: _draw(seed, len(tried), sorted(n[0]), n[1])):
            add(names, learner)
    else:
        add(groups, learners[0])  # all groups are the first trial
    for i in range(64 * many):
        draw = partial(_draw, seed, len(tried), i)
        add([g for g in groups if draw(g) & 1], learners[draw("learner") % len(learners)])
    return out


def group_search(rows: DataFrame, groups: dict[str, list[int]], learners: tuple[str, ...] = ("forest",), trials: int = 12, folds: int = 5, score: str = "balanced_accuracy", seed: int = 63, parallel: int = 4, kind: str = "classifier", settings: dict | None = None) -> tuple[Trial | None, list[Trial]]:
    """Which groups of features, named with their places, and which learner do best by folds: the best trial and all of them.

    The first half of the trials are drawn, the others begin at the best so far. Binary labels are usually scored by
    balanced_accuracy, several by f1_weighted, numbers (kind="regressor") by r2. A table in which no trial can be fitted has
    no best one.
    """
    rows = rows.select("id", "features", "label", "fold").persist()
    done: list[Trial] = []
    try:
        while len(done) < trials:
            best = best_of(done) if len(done) >= trials // 2 else None
            new = proposals(groups, learners, min(parallel, trials - len(done)), seed, done, best)
            if not new:
                break
            done += _run(rows, new, parallel, done, folds=folds, score=score, seed=seed, kind=kind, settings=settings)
    finally:
        rows.unpersist()
    return best_of(done), done


def presence(spark, groups: dict[str, list[int]], best: Trial) -> DataFrame:
    """One row: 1 for each group that the best trial has, else 0."""
    return spark.createDataFrame([tuple(int(g in best.groups) for g in groups)], ", ".join(f"`{g}` int" for g in groups))


def refit(rows: DataFrame, trial: Trial, kind: str = "classifier", seed: int = 63, settings: dict | None = None) -> tuple[DataFrame, object]:
    """A model of all training rows by the trial's choices; apply it to chosen(rows, trial.columns)."""
    return M.fit(chosen(resampled(rows, trial.resample, seed), trial.columns), trial.learner, kind, seed, **(settings or {}))


def pick_algorithm(rows: DataFrame, learners: tuple[str, ...] = ("forest", "boosted", "logistic"), folds: int = 2, score: str = "balanced_accuracy", seed: int = 63, parallel: int = 3, kind: str = "classifier", settings: dict | None = None) -> tuple[Trial | None, list[Trial]]:
    """The learner that does best by folds, and all of them with their scores."""
    rows = rows.select("id", "features", "label", "fold").persist()
    try:
        found = _run(rows, [Trial(i, learner=x) for i, x in enumerate(learners)], parallel, folds=folds, score=score, seed=seed, kind=kind, settings=settings)
    finally:
        rows.unpersist()
    return best_of(found), found


def pick_resampler(rows: DataFrame, learner: str = "forest", options: tuple[str, ...] = ("smote", "under"), folds: int = 2, seed: int = 63, parallel: int = 2, settings: dict | None = None) -> tuple[Trial, list[Trial]]:
    """The resampler that does best by balanced accuracy where training rows alone are resampled; "none" where all labels have as many
    rows. Held-out rows stay as they are."""
    rows = rows.select("id", "features", "label", "fold").persist()
    try:
        n = rows.groupBy("label").count().agg(F.min("count").alias("least"), F.max("count").alias("most")).first()
        if n["least"] == n["most"]:
            return Trial(0, learner=learner, state="balanced"), []
        found = _run(rows, [Trial(i, learner=learner, resample=x) for i, x in enumerate(options)], parallel, folds=folds, seed=seed, settings=settings)
    finally:
        rows.unpersist()
    return best_of(found) or Trial(0, learner=learner), found


def thresholds(weights: list[float], most: int, seed: int) -> list[float]:
    """Distinct importances that may be thresholds: all but the largest, of more than `most` a drawn sample."""
    own = sorted(set(weights))[:-1]
    return sorted(sorted(own, key=lambda w: _draw(seed, repr(w)))[:most])


def threshold_search(rows: DataFrame, learner: str = "forest", folds: int = 5, most: int = 10, score: str = "balanced_accuracy", seed: int = 63, parallel: int = 4, settings: dict | None = None) -> tuple[float, list[int], list[Trial]]:
    """The importance a feature must reach, the places of the features that do in all rows, and the trials (note: the threshold).

    Each fold's features are chosen by importances of its own training rows, which are fitted once for all thresholds; of equally good
    thresholds the larger is taken. Without any better one the threshold is 0: all features stay.
    """
    rows = rows.select("id", "features", "label", "fold").persist()
    spark = rows.sparkSession
    try:
        def weights_of(train: DataFrame) -> list[float]:
            got = M.importances(spark, M.fit(train, learner, "classifier", seed, **(settings or {}))).collect()
            return [w for _, w in sorted((int(r["feature"][1:]), r["importance"]) for r in got)]

        whole = weights_of(rows)
        with ThreadPool(parallel) as pool:
            by_fold = pool.map(lambda k: weights_of(rows.where(F.col("fold") != k)), range(folds))

        def one(numbered: tuple[int, float]) -> Trial:
            i, least = numbered
            total = 0.0
            for k in range(folds):
                columns = [j for j, w in enumerate(by_fold[k]) if w >= least]
                if not columns:
                    return Trial(i, learner=learner, state="failed", folds=k, note=repr(least))
                fitted = M.fit(chosen(training_rows(rows, k, "none", seed), columns), learner, "classifier", seed, **(settings or {}))
                held = M.apply(chosen(rows.where(F.col("fold") == k), columns), fitted)
                total += score_of(held.select(F.col("label").alias("real"), "pred"), score)
            return Trial(i, columns=tuple(j for j, w in enumerate(whole) if w >= least), learner=learner, state="done", folds=folds, score=round(total / folds, 6), note=repr(least))

        with ThreadPool(parallel) as pool:
            found = pool.map(one, enumerate([0.0, *thresholds(whole, most, seed)]), chunksize=1)
    finally:
        rows.unpersist()
    best = max((t for t in found if t.state == "done"), key=lambda t: (t.score, float(t.note)), default=None)
    least = float(best.note) if best else 0.0
    return least, [j for j, w in enumerate(whole) if w >= least], found
