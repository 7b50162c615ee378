"""Queries over feature tables, predictions, job logs and catalogues, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.operators import evaluation as E
from strandloom.operators import features as X
from strandloom.operators.sequences import ranked, read

Q: dict = {}
SQL: dict[str, str] = {}

#: (id, label, feature, value): the components of each vector.
LONG = "e0 AS (SELECT vec_id, label, embedding, unnest(range(0, len(embedding))) AS pos FROM embeddings), x AS (SELECT vec_id AS id, label, 'f' || pos::varchar AS feature, embedding[pos + 1]::double AS value FROM e0)"
#: Pseudo-predictions: every seventh vector gets the next label.
PRED = "p AS (SELECT vec_id AS id, label AS real, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS pred, embedding[1]::double AS score FROM embeddings)"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _x(spark, d):
    return X.feature_table(spark, d)


def _p(spark, d):
    pred = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("real"), pred.alias("pred"), F.col("embedding")[0].cast("double").alias("score"))


# features


@query("structured_ingest", "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::bigint AS nameseq, o_totalprice, 'Predicted' AS label FROM orders")
def _(spark, d):
    # the row number is prefix counts over key ranges plus a rank within each range
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumn("range", F.floor(F.col("o_orderkey") / 1024))
    n = o.groupBy("range").agg(F.count("*").alias("n"))
    n = n.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("o_orderkey"))
    return o.withColumn("rank", rank).join(n, "range").select((F.col("before") + F.col("rank") - 1).alias("nameseq"), "o_totalprice", F.lit("Predicted").alias("label"))


Q["long_features"] = lambda spark, d: _x(spark, d).select("id", "feature", F.round("value", 6).alias("value"))
SQL["long_features"] = f"WITH {LONG} SELECT id, feature, round(value, 6) AS value FROM x"
Q["descriptor_slice"] = lambda spark, d: _x(spark, d).where(F.col("feature").isin("f1", "f3")).select("id", "feature", F.round("value", 6).alias("value"))
SQL["descriptor_slice"] = f"WITH {LONG} SELECT id, feature, round(value, 6) AS value FROM x WHERE feature IN ('f1', 'f3')"
Q["standard_scale"] = lambda spark, d: X.standard_scale(_x(spark, d))
SQL["standard_scale"] = f"WITH {LONG}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM x GROUP BY feature) SELECT id, feature, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM x JOIN s USING (feature)"
Q["minmax_scale"] = lambda spark, d: X.minmax_scale(_x(spark, d))
SQL["minmax_scale"] = f"WITH {LONG}, s AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM x GROUP BY feature) SELECT id, feature, round((value - lo) / nullif(hi - lo, 0), 6) AS value FROM x JOIN s USING (feature)"
Q["impute_mean"] = lambda spark, d: X.impute_mean(_x(spark, d).withColumn("value", F.when(F.col("id") % 11 != 0, F.col("value"))))
SQL["impute_mean"] = f"WITH {LONG}, y AS (SELECT id, feature, CASE WHEN id % 11 <> 0 THEN value END AS value FROM x), s AS (SELECT feature, avg(value) AS m FROM y GROUP BY feature) SELECT id, feature, round(coalesce(value, m), 6) AS value FROM y JOIN s USING (feature)"
Q["pearson_pairs"] = lambda spark, d: X.pearson_pairs(_x(spark, d))
SQL["pearson_pairs"] = f"WITH {LONG} SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS c FROM x a JOIN x b ON a.id = b.id AND a.feature < b.feature GROUP BY 1, 2"
Q["spearman_pairs"] = lambda spark, d: X.pearson_pairs(X.average_rank(_x(spark, d)))
SQL["spearman_pairs"] = (
    f"WITH {LONG}, r AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::double AS value FROM x) "
    "SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS c FROM r a JOIN r b ON a.id = b.id AND a.feature < b.feature GROUP BY 1, 2"
)
Q["feature_histogram"] = lambda spark, d: X.histogram(_x(spark, d).where("feature = 'f0'").withColumn("label", F.col("label").cast("string")), 10, "0")
SQL["feature_histogram"] = (
    f"WITH {LONG}, y AS (SELECT label::varchar AS label, value FROM x WHERE feature = 'f0'), r AS (SELECT min(value) AS lo, max(value) AS hi FROM y WHERE label = '0') "
    "SELECT label, least(floor((value - lo) / (hi - lo) * 10), 9)::bigint AS bin, count(*)::bigint AS n FROM y, r WHERE value BETWEEN lo AND hi GROUP BY 1, 2"
)


@query(
    "align_join",
    "SELECT coalesce(a.doc_id, b.doc_id) AS seq_id, a.n_chars, b.quality, b.toxic FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id",
)
def _(spark, d):
    a = read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), "n_chars")
    b = read(spark, d, "labels").select(F.col("doc_id").alias("seq_id"), "quality", "toxic")
    return a.join(b, "seq_id", "full_outer")


@query("label_encode", "SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::int AS code FROM documents")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang")
    # the classes are few and are ranked alone
    codes = docs.select("lang").distinct().withColumn("code", F.row_number().over(Window.orderBy("lang")) - 1)
    return docs.join(codes, "lang").select("doc_id", "code")


@query("importance_rank", f"WITH {LONG}, i AS (SELECT feature, round(avg(abs(value)), 6) AS importance FROM x GROUP BY feature) SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature)::int AS rank FROM i")
def _(spark, d):
    i = _x(spark, d).groupBy("feature").agg(F.round(F.avg(F.abs("value")), 6).alias("importance"))
    return i.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


@query("top_features", f"WITH {LONG} SELECT feature, round(avg(abs(value)), 6) AS importance FROM x GROUP BY feature ORDER BY importance DESC, feature LIMIT 5")
def _(spark, d):
    return _x(spark, d).groupBy("feature").agg(F.round(F.avg(F.abs("value")), 6).alias("importance")).orderBy(F.desc("importance"), "feature").limit(5)


@query("argmax_label", "WITH e AS (SELECT vec_id, embedding AS v FROM embeddings) SELECT vec_id, (list_position(v, list_max(v)) - 1)::int AS cls FROM e")
def _(spark, d):
    v = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", (F.array_position(v, F.array_max(v)) - 1).cast("int").alias("cls"))


@query("descriptor_presence", f"WITH {LONG} SELECT count(*) FILTER (WHERE feature = 'f1') > 0 AS has_f1, count(*) FILTER (WHERE feature = 'f9') > 0 AS has_f9 FROM x")
def _(spark, d):
    return _x(spark, d).agg(*[(F.count(F.when(F.col("feature") == f, 1)) > 0).alias(f"has_{f}") for f in ("f1", "f9")])


# evaluation

Q["confusion_matrix"] = lambda spark, d: E.confusion(_p(spark, d))
SQL["confusion_matrix"] = f"WITH {PRED} SELECT coalesce(real::varchar, 'All') AS real, coalesce(pred::varchar, 'All') AS pred, count(*)::bigint AS n FROM p GROUP BY CUBE (real, pred)"
_CLASS = f"{PRED}, c AS (SELECT cls, sum((kind = 2)::int)::double AS tp, sum((kind = 0)::int)::double AS support, sum((kind = 1)::int)::double AS predicted FROM (SELECT real AS cls, 0 AS kind FROM p UNION ALL SELECT pred, 1 FROM p UNION ALL SELECT real, 2 FROM p WHERE real = pred) GROUP BY cls)"
_RATES = f"{_CLASS}, r AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"
Q["classification_report"] = lambda spark, d: E.report(_p(spark, d))
SQL["classification_report"] = f"WITH {_RATES} SELECT cls, round(precision, 6)::double AS precision, round(recall, 6)::double AS recall, round(f1, 6)::double AS f1, support::bigint AS support FROM f"
Q["classification_metrics"] = lambda spark, d: E.summary(_p(spark, d))
SQL["classification_metrics"] = (
    f"WITH {_RATES}, s AS (SELECT sum(support) AS n, sum(tp) AS t, sum(support * predicted) AS x, sum(support * support) AS rr, sum(predicted * predicted) AS pp, avg(recall) FILTER (WHERE support > 0) AS ba, avg(f1) AS fm, sum(f1 * support) / sum(support) AS fw, "
    "CASE WHEN min(recall) FILTER (WHERE support > 0) = 0 THEN 0 ELSE exp(avg(ln(CASE WHEN support > 0 AND recall > 0 THEN recall END))) END AS g FROM f) "
    "SELECT round(t / n, 6) AS accuracy, round(ba, 6) AS balanced_accuracy, round(g, 6)::double AS gmean, round(fm, 6) AS f1_macro, round(fw, 6) AS f1_weighted, round((t / n - x / (n * n)) / (1 - x / (n * n)), 6) AS kappa, round((t * n - x) / sqrt((n * n - rr) * (n * n - pp)), 6) AS mcc FROM s"
)
Q["roc_auc"] = lambda spark, d: E.roc_auc(_p(spark, d).select((F.col("real") < 5).cast("int").alias("real"), "score"))
SQL["roc_auc"] = (
    f"WITH {PRED}, y AS (SELECT (real < 5)::int AS real, score FROM p), r AS (SELECT real, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS r FROM y) "
    "SELECT round((sum(r) FILTER (WHERE real = 1) - sum(real)::double * (sum(real) + 1) / 2) / (sum(real)::double * sum(1 - real)), 6) AS auc FROM r"
)
Q["regression_metrics"] = lambda spark, d: E.regression(read(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("real"), (F.col("l_quantity") * 1.5).alias("pred")))
SQL["regression_metrics"] = "WITH p AS (SELECT l_extendedprice / 1000 AS real, l_quantity * 1.5::double AS pred FROM lineitem) SELECT round(avg(abs(real - pred)), 6) AS mae, round(avg((real - pred) * (real - pred)), 6) AS mse, round(sqrt(avg((real - pred) * (real - pred))), 6) AS rmse, round(1 - sum((real - pred) * (real - pred)) / (var_pop(real) * count(*)), 6) AS r2 FROM p"


_YES = f"{PRED}, y AS (SELECT id % 5 AS fold, (real < 5)::int AS real, (pred < 5)::int AS pred, score FROM p)"
_MEASURES = (
    "SELECT *, (tp + tn) / (tp + tn + fp + fn) AS acc, tp / (tp + fn) AS sn, tn / (tn + fp) AS sp, 2 * tp / (2 * tp + fp + fn) AS f1, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, "
    "(tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_acc, sqrt(tp / (tp + fn) * (tn / (tn + fp))) AS gmean, ((tp + tn) / (tp + tn + fp + fn) - e) / (1 - e) AS kappa FROM (SELECT *, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / pow(tp + tn + fp + fn, 2) AS e FROM m)"
)
_COUNTS = "count(*) FILTER (WHERE real = 1 AND pred = 1)::double AS tp, count(*) FILTER (WHERE real = 0 AND pred = 0)::double AS tn, count(*) FILTER (WHERE real = 0 AND pred = 1)::double AS fp, count(*) FILTER (WHERE real = 1 AND pred = 0)::double AS fn"


def _yes(spark, d):
    return _p(spark, d).select((F.col("id") % 5).alias("fold"), (F.col("real") < 5).cast("int").alias("real"), (F.col("pred") < 5).cast("int").alias("pred"), "score")


Q["cv_summary"] = lambda spark, d: E.cv_table(_yes(spark, d), "fold")
SQL["cv_summary"] = (
    f"WITH {_YES}, m AS (SELECT fold, {_COUNTS} FROM y GROUP BY fold), r AS (SELECT fold, real, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::double AS r FROM y), "
    "a AS (SELECT fold, (sum(r) FILTER (WHERE real = 1) - sum(real)::double * (sum(real) + 1) / 2) / (sum(real)::double * sum(1 - real)) AS auc FROM r GROUP BY fold) "
    f"SELECT {', '.join(f'round(avg({c}), 4) AS mean_{c}, round(stddev_pop({c}), 4) AS std_{c}' for c in E.CV_COLUMNS)}, count(*)::bigint AS folds FROM ({_MEASURES}) JOIN a USING (fold)"
)
Q["metrics_from_confusion"] = lambda spark, d: E.from_matrix(E.confusion(_yes(spark, d)), "1")
SQL["metrics_from_confusion"] = f"WITH {_YES}, m AS (SELECT {_COUNTS} FROM y) SELECT tp::bigint AS tp, tn::bigint AS tn, fp::bigint AS fp, fn::bigint AS fn, {', '.join(f'round({c}, 6) AS {c}' for c in E.CV_COLUMNS if c != 'auc')} FROM ({_MEASURES})"

# job log and catalogue


@query("latest_status", "SELECT user_id, arg_max(event_type, ts::varchar || lpad(event_id::varchar, 12, '0')) AS status, max(ts) AS at FROM events GROUP BY user_id")
def _(spark, d):
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return read(spark, d, "events").groupBy("user_id").agg(last.alias("x")).select("user_id", F.col("x.event_type").alias("status"), F.col("x.ts").alias("at"))


@query(
    "queue_position",
    "WITH w AS (SELECT user_id, min(ts) AS start FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id) SELECT user_id, row_number() OVER (ORDER BY start, user_id)::int AS position FROM w",
)
def _(spark, d):
    e = read(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("kind"))
    w = e.join(F.broadcast(kind), F.col("event_type") == F.col("kind")).groupBy("user_id").agg(F.min("ts").alias("start"))
    return ranked(w, "start", "user_id", name="position").select("user_id", F.col("position").cast("int").alias("position"))


@query(
    "recent_completed",
    "WITH t AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id), s AS (SELECT *, (floor(epoch(b))::bigint - floor(epoch(a))::bigint) AS secs FROM t) SELECT user_id, printf('%02d:%02d:%02d', secs // 3600, secs % 3600 // 60, secs % 60) AS duration FROM s ORDER BY b DESC, user_id LIMIT 5",
)
def _(spark, d):
    t = read(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    s = t.withColumn("secs", F.unix_timestamp("b") - F.unix_timestamp("a"))
    text = F.format_string("%02d:%02d:%02d", F.floor(F.col("secs") / 3600), F.floor(F.col("secs") % 3600 / 60), F.col("secs") % 60)
    return s.orderBy(F.desc("b"), "user_id").limit(5).select("user_id", text.alias("duration"))


@query("runs_mean_std", "SELECT o_orderpriority AS dataset, printf('%.3f', round(avg(o_totalprice), 3)) || ' ± ' || printf('%.3f', round(stddev_samp(o_totalprice), 3)) AS score FROM orders GROUP BY 1")
def _(spark, d):
    text = F.concat(F.format_string("%.3f", F.round(F.avg("o_totalprice"), 3)), F.lit(" ± "), F.format_string("%.3f", F.round(F.stddev_samp("o_totalprice"), 3)))
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(text.alias("score"))


@query(
    "class_totals",
    "SELECT count(*) FILTER (WHERE quality = 1)::bigint AS positive, count(*) FILTER (WHERE quality = 0)::bigint AS negative, count(DISTINCT quality)::bigint AS classes FROM labels",
)
def _(spark, d):
    n = lambda v: F.count(F.when(F.col("quality") == v, 1))
    return read(spark, d, "labels").agg(n(1).alias("positive"), n(0).alias("negative"), F.countDistinct("quality").alias("classes"))


@query("dataset_composition", "SELECT source, string_agg(lang || ': ' || n::varchar, ', ' ORDER BY lang) AS composition FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def _(spark, d):
    n = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat(x["lang"], F.lit(": "), x["n"].cast("string")))
    return n.groupBy("source").agg(F.array_join(parts, ", ").alias("composition"))


@query(
    "pending_runs",
    "WITH r AS (SELECT DISTINCT o_orderpriority AS dataset, unnest(range(6, 11))::int AS run FROM orders), done AS (SELECT DISTINCT o_orderpriority AS dataset, (6 + o_orderkey % 3)::int AS run FROM orders) SELECT dataset, run FROM r ANTI JOIN done USING (dataset, run)",
)
def _(spark, d):
    o = read(spark, d, "orders")
    grid = o.select(F.col("o_orderpriority").alias("dataset")).distinct().select("dataset", F.explode(F.sequence(F.lit(6), F.lit(10))).alias("run"))
    done = o.select(F.col("o_orderpriority").alias("dataset"), (6 + F.col("o_orderkey") % 3).cast("int").alias("run")).distinct()
    return grid.join(done, ["dataset", "run"], "left_anti")


@query(
    "benchmark_wins",
    "WITH s AS (SELECT o_orderpriority AS dataset, year(o_orderdate) AS run, avg(o_totalprice) AS score FROM orders GROUP BY ALL), r AS (SELECT avg(o_totalprice) AS ref, stddev_samp(o_totalprice) AS dev FROM orders) SELECT dataset, sum((score >= ref)::int)::bigint AS wins, sum((abs(score - ref) <= dev)::int)::bigint AS ties, count(*)::bigint AS cells FROM s, r GROUP BY dataset",
)
def _(spark, d):
    o = read(spark, d, "orders")
    s = o.groupBy(F.col("o_orderpriority").alias("dataset"), F.year("o_orderdate").alias("run")).agg(F.avg("o_totalprice").alias("score"))
    r = o.agg(F.avg("o_totalprice").alias("ref"), F.stddev_samp("o_totalprice").alias("dev"))
    s = s.join(F.broadcast(r))
    return s.groupBy("dataset").agg(F.sum((F.col("score") >= F.col("ref")).cast("int")).alias("wins"), F.sum((F.abs(F.col("score") - F.col("ref")) <= F.col("dev")).cast("int")).alias("ties"), F.count("*").alias("cells"))


@query("parse_dataset_id", "SELECT doc_id, regexp_extract(source, '([0-9]+)', 1)::int AS number FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("number"))


@query("parse_mean_std", "WITH t AS (SELECT o_orderkey, printf('%.3f', round(o_totalprice) / 1000) || ' ± ' || printf('%.3f', round(o_totalprice / 100) / 1000) AS cell FROM orders) SELECT o_orderkey, regexp_extract(cell, '^([0-9.]+)', 1)::double AS mean, regexp_extract(cell, '± ([0-9.]+)', 1)::double AS std FROM t")
def _(spark, d):
    cell = F.concat(F.format_string("%.3f", F.round("o_totalprice") / 1000), F.lit(" ± "), F.format_string("%.3f", F.round(F.col("o_totalprice") / 100) / 1000))
    t = read(spark, d, "orders").select("o_orderkey", cell.alias("cell"))
    return t.select("o_orderkey", F.regexp_extract("cell", "^([0-9.]+)", 1).cast("double").alias("mean"), F.regexp_extract("cell", "± ([0-9.]+)", 1).cast("double").alias("std"))


Q["feature_means"] = lambda spark, d: _x(spark, d).groupBy("label", "feature").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))
SQL["feature_means"] = f"WITH {LONG} SELECT label, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM x GROUP BY label, feature"
