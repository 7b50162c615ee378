"""Evaluation of predictions (id, real, pred[, score]): everything comes from the confusion counts or plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(p: DataFrame) -> DataFrame:
    """(real, pred, n) with All margins, by grouping sets."""
    c = p.select(F.col("real").cast("string").alias("real"), F.col("pred").cast("string").alias("pred")).cube("real", "pred").agg(F.count("*").alias("n"))
    return c.select(F.coalesce("real", F.lit("All")).alias("real"), F.coalesce("pred", F.lit("All")).alias("pred"), "n")


def per_class(p: DataFrame) -> DataFrame:
    """(cls, tp, support, predicted) of every class that occurs."""
    both = p.select(F.explode(F.array(F.struct(F.col("real").alias("cls"), F.lit(1).alias("r"), F.lit(0).alias("q"), (F.col("real") == F.col("pred")).cast("int").alias("t")), F.struct(F.col("pred").alias("cls"), F.lit(0).alias("r"), F.lit(1).alias("q"), F.lit(0).alias("t")))).alias("x"))
    return both.groupBy("x.cls").agg(F.sum("x.t").alias("tp"), F.sum("x.r").alias("support"), F.sum("x.q").alias("predicted"))


def report(p: DataFrame) -> DataFrame:
    """(cls, precision, recall, f1, support) of each class."""
    c = per_class(p)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.select("cls", zero("tp", "predicted").alias("precision"), zero("tp", "support").alias("recall"), "support")
    f1 = zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.select("cls", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def summary(p: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy, G-mean, macro and weighted F1, Cohen's kappa, Matthews correlation."""
    c = per_class(p)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, precision = zero("tp", "support"), zero("tp", "predicted")
    c = c.select("tp", "support", "predicted", recall.alias("recall"), zero(2 * precision * recall, precision + recall).alias("f1"))
    n, tp, cross = F.sum("support"), F.sum("tp"), F.sum(F.col("support") * F.col("predicted"))
    rr, pp = F.sum(F.col("support") * F.col("support")), F.sum(F.col("predicted") * F.col("predicted"))
    true = F.when(F.col("support") > 0, F.col("recall"))
    gmean = F.when(F.min(true) == 0, 0.0).otherwise(F.exp(F.avg(F.when(true > 0, F.ln(true)))))
    root = F.sqrt((n.cast("double") * n - rr) * (n.cast("double") * n - pp))
    return c.agg(
        F.round(tp / n, 6).alias("accuracy"), F.round(F.avg(true), 6).alias("balanced_accuracy"), F.round(gmean, 6).alias("gmean"), F.round(F.avg("f1"), 6).alias("f1_macro"),
        F.round(F.sum(F.col("f1") * F.col("support")) / n, 6).alias("f1_weighted"), F.round((tp / n - cross / (n.cast("double") * n)) / (1 - cross / (n.cast("double") * n)), 6).alias("kappa"),
        F.round(F.coalesce(F.try_divide(tp.cast("double") * n - cross, root), F.lit(0.0)), 6).alias("mcc"),
    )


def roc_auc(p: DataFrame) -> DataFrame:
    """One row (auc) of (real 0 or 1, score): the Mann-Whitney statistic over distinct scores, ties at half.

    Counts are summed by score first; the running sum is taken within ranges of scores, after the sums of the ranges before.
    """
    from pyspark.sql import Window

    s = p.groupBy("score").agg(F.sum(F.col("real")).alias("pos"), F.sum(1 - F.col("real")).alias("neg"))
    s = s.withColumn("range", F.rint(F.col("score") * 1024))
    n = s.groupBy("range").agg(F.sum("neg").alias("all"))
    n = n.select(F.col("range").alias("at"), (F.sum("all").over(Window.orderBy("range")) - F.col("all")).alias("before"))
    within = F.sum("neg").over(Window.partitionBy("range").orderBy("score")) - F.col("neg")
    s = s.withColumn("within", within).join(n, F.col("range").eqNullSafe(F.col("at"))).select("pos", "neg", (F.col("before") + F.col("within")).alias("below"))
    return s.agg(F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)) / (F.sum("pos").cast("double") * F.sum("neg")), 6).alias("auc"))


def regression(p: DataFrame) -> DataFrame:
    """One row (mae, mse, rmse, r2) of (real, pred)."""
    e = F.col("real") - F.col("pred")
    mse = F.avg(e * e)
    return p.agg(F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(mse, 6).alias("mse"), F.round(F.sqrt(mse), 6).alias("rmse"), F.round(1 - F.sum(e * e) / (F.var_pop("real") * F.count("*")), 6).alias("r2"))


def class_rates(p: DataFrame) -> DataFrame:
    """(cls, sensitivity, specificity, support) of each class against all others; null where a class has no rows to judge by."""
    n = p.agg(F.count("*").alias("n"))
    c = per_class(p).join(F.broadcast(n))
    negatives = F.col("n") - F.col("support")
    true_negatives = negatives - (F.col("predicted") - F.col("tp"))
    return c.select("cls", F.round(F.try_divide("tp", "support"), 6).alias("sensitivity"), F.round(F.try_divide(true_negatives, negatives), 6).alias("specificity"), "support")


def report_averages(p: DataFrame) -> DataFrame:
    """(average, precision, recall, f1): the classes' plain mean, their mean weighted by support, and all rows' counts together."""
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = zero("tp", "predicted"), zero("tp", "support")
    c = per_class(p).select("tp", "support", "predicted", precision.alias("precision"), recall.alias("recall"), zero(2 * precision * recall, precision + recall).alias("f1"))
    three = ("precision", "recall", "f1")
    macro = [F.round(F.avg(x), 6).alias(x) for x in three]
    weighted = [F.round(F.sum(F.col(x) * F.col("support")) / F.sum("support"), 6).alias(x) for x in three]
    micro = [F.round(F.sum("tp") / F.sum("support"), 6).alias(x) for x in three]
    row = lambda name, values: F.struct(F.lit(name).alias("average"), *values)
    return c.agg(F.array(row("macro", macro), row("weighted", weighted), row("micro", micro)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def regression_by(p: DataFrame, fold: str) -> DataFrame:
    """(fold, mae, mse, rmse, r2) of (real, pred) in each fold."""
    e = F.col("real") - F.col("pred")
    mse = F.avg(e * e)
    r2 = 1 - F.sum(e * e) / (F.var_pop("real") * F.count("*"))
    return p.groupBy(fold).agg(F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(mse, 6).alias("mse"), F.round(F.sqrt(mse), 6).alias("rmse"), F.round(r2, 6).alias("r2"))


def auc_by(p: DataFrame, fold: str) -> DataFrame:
    """(fold, auc) of (real 0 or 1, score) in each fold; null where a fold lacks one of the classes."""
    from pyspark.sql import Window

    s = p.groupBy(fold, "score").agg(F.sum(F.col("real")).alias("pos"), F.sum(1 - F.col("real")).alias("neg")).withColumn("range", F.rint(F.col("score") * 1024))
    n = s.groupBy(fold, "range").agg(F.sum("neg").alias("all"))
    n = n.select(fold, "range", (F.sum("all").over(Window.partitionBy(fold).orderBy("range")) - F.col("all")).alias("before"))
    within = F.sum("neg").over(Window.partitionBy(fold, "range").orderBy("score")) - F.col("neg")
    s = s.withColumn("within", within).join(n, [fold, "range"]).select(fold, "pos", "neg", (F.col("before") + F.col("within")).alias("below"))
    return s.groupBy(fold).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


#: Columns of a table of folds: each has a mean and a population deviation.
CV_COLUMNS = ("acc", "sn", "sp", "f1", "mcc", "auc", "balanced_acc", "kappa", "gmean")


def _binary(m: DataFrame) -> DataFrame:
    """The measures of each row of counts (tp, tn, fp, fn), but the area; those that divide by nothing are 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sn, sp, acc = zero(tp, tp + fn), zero(tn, tn + fp), zero(tp + tn, n)
    chance = zero((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    mcc = zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    values = {"acc": acc, "sn": sn, "sp": sp, "f1": zero(2 * tp, 2 * tp + fp + fn), "mcc": mcc, "balanced_acc": (sn + sp) / 2, "kappa": zero(acc - chance, 1 - chance), "gmean": F.sqrt(sn * sp)}
    return m.withColumns(values)


def binary_counts(p: DataFrame, *by: str) -> DataFrame:
    """(by, tp, tn, fp, fn) of (real, pred), 0 or 1."""
    n = lambda r, q, name: F.count(F.when((F.col("real") == r) & (F.col("pred") == q), 1)).alias(name)
    return p.groupBy(*by).agg(n(1, 1, "tp"), n(0, 0, "tn"), n(0, 1, "fp"), n(1, 0, "fn"))


def cv_table(p: DataFrame, fold: str) -> DataFrame:
    """One row: mean and population deviation over the folds of nine measures of (real, pred, score), and the number of folds: accuracy,
    sensitivity, specificity, F1, Matthews correlation, area under the curve, balanced accuracy, kappa, G-mean; four digits."""
    each = _binary(binary_counts(p, fold)).join(auc_by(p, fold), fold)
    columns = [f(c, name) for c in CV_COLUMNS for f, name in ((lambda c, n: F.round(F.avg(c), 4).alias(n), f"mean_{c}"), (lambda c, n: F.round(F.stddev_pop(c), 4).alias(n), f"std_{c}"))]
    return each.agg(*columns, F.count("*").alias("folds"))


def from_matrix(m: DataFrame, positive: str) -> DataFrame:
    """One row of a stored confusion matrix (real, pred, n), with or without margins named All: the counts of the positive class against
    all others, and the measures that follow from them, six digits."""
    inner = m.where("real <> 'All' and pred <> 'All'").select((F.col("real") == positive).alias("r"), (F.col("pred") == positive).alias("q"), "n")
    n = lambda r, q, name: F.coalesce(F.sum(F.when((F.col("r") == r) & (F.col("q") == q), F.col("n"))), F.lit(0)).alias(name)
    counts = inner.agg(n(True, True, "tp"), n(False, False, "tn"), n(False, True, "fp"), n(True, False, "fn"))
    return _binary(counts).select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in CV_COLUMNS if c != "auc"])
