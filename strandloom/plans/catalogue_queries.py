"""Queries over tables around models, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import evaluation as E
from strandloom.operators import features as X
from strandloom.operators import models as M
from strandloom.operators import search as SE
from strandloom.operators import tables as T
from strandloom.operators.sequences import read
from strandloom.plans.table_queries import LONG, PRED, _p

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("key_last", "SELECT o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderkey FROM orders")
def _(spark, d):
    return T.key_last(read(spark, d, "orders"), "o_orderkey", ("o_orderstatus",))


@query("split_filter", "SELECT doc_id, n_chars FROM (SELECT *, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents) WHERE split = 'test'")
def _(spark, d):
    tagged = read(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test"))
    return tagged.where("split = 'test'").select("doc_id", "n_chars")


@query("seen_columns", "SELECT l_quantity, NULL::double AS l_weight, l_extendedprice FROM lineitem")
def _(spark, d):
    return T.seen_columns(read(spark, d, "lineitem"), ["l_quantity", "l_weight", "l_extendedprice"])


@query("distinct_columns", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, d):
    o = read(spark, d, "orders")
    return T.distinct_columns(o.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("o_orderkey")))


@query("align_many", "SELECT n_chars, quality, score, coalesce(a.doc_id, b.doc_id, c.doc_id) AS doc_id FROM documents a FULL JOIN labels b USING (doc_id) FULL JOIN (SELECT vec_id AS doc_id, embedding[1]::double AS score FROM embeddings) c USING (doc_id)")
def _(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding")[0].cast("double").alias("score"))
    return T.align([read(spark, d, "documents").select("doc_id", "n_chars"), read(spark, d, "labels").select("doc_id", "quality"), v], "doc_id")


@query("side_by_side", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(spark, d):
    return T.side_by_side([read(spark, d, "documents").select("doc_id", "n_chars"), read(spark, d, "labels").select("doc_id", "quality", "toxic")], "doc_id")


_TAB = f"WITH {PRED}, t AS (SELECT coalesce(real::varchar, 'All') AS real, coalesce(pred::varchar, 'All') AS pred, count(*)::bigint AS n FROM p GROUP BY CUBE (real, pred))"


@query("crosstab_without_totals", f"{_TAB} SELECT * FROM t WHERE real <> 'All' AND pred <> 'All'")
def _(spark, d):
    return T.without_totals(E.confusion(_p(spark, d)), "real", "pred")


@query("square_crosstab", f"WITH {PRED}, t AS (SELECT real, pred, count(*)::bigint AS n FROM p WHERE real < 7 AND pred > 2 GROUP BY ALL), b AS (SELECT real AS x FROM t INTERSECT SELECT pred FROM t) SELECT real, pred, n FROM t WHERE real IN (FROM b) AND pred IN (FROM b)")
def _(spark, d):
    return T.square(_p(spark, d).where("real < 7 and pred > 2").groupBy("real", "pred").agg(F.count("*").alias("n")), "real", "pred")


@query("probability_percent", "SELECT l_orderkey, l_linenumber, round(l_discount * 100, 6) AS l_discount, round(l_tax * 100, 6) AS l_tax FROM lineitem")
def _(spark, d):
    p = T.percent(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), "l_discount", "l_tax")
    return p.withColumns({c: F.round(c, 6) for c in ("l_discount", "l_tax")})


_CELLS = ("l_orderkey", "l_quantity", "l_ratio", "l_log")
_CHECKED = "x AS (SELECT l_orderkey, l_quantity, CASE WHEN l_tax = 0 THEN 'inf'::double ELSE l_discount / l_tax END AS l_ratio, CASE WHEN l_discount > 0 THEN ln(l_discount) END AS l_log FROM lineitem)"


@query("null_and_infinite", f"WITH {_CHECKED} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL OR isnan({c}::double))::bigint AS nulls, count(*) FILTER (WHERE isinf({c}::double))::bigint AS infinite FROM x" for c in _CELLS))
def _(spark, d):
    x = read(spark, d, "lineitem")
    ratio = F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.try_divide("l_discount", "l_tax"))
    return T.null_and_infinite(x.select("l_orderkey", "l_quantity", ratio.alias("l_ratio"), F.when(F.col("l_discount") > 0, F.log("l_discount")).alias("l_log")))


@query("labels_with_check", "WITH f AS (SELECT doc_id, quality AS label FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, label, (SELECT count(*) FILTER (WHERE label IS NULL) FROM f)::bigint AS missing FROM f")
def _(spark, d):
    return T.labels_of(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


_NAMES = "r AS (SELECT DISTINCT source AS name, regexp_extract(source, '([0-9]+)$', 1) AS n FROM documents WHERE source IS NOT NULL)"


@query(
    "model_lookup",
    f"WITH {_NAMES}, m AS (SELECT DISTINCT s_nationkey AS model FROM supplier), c AS (SELECT model, CASE WHEN n = model::varchar THEN 0 ELSE 1 END AS rule, name FROM m JOIN r ON n <> '' AND contains(n, model::varchar)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rule, name) AS k FROM c) SELECT model, rule::int AS rule, name FROM k WHERE k = 1",
)
def _(spark, d):
    models = read(spark, d, "supplier").select(F.col("s_nationkey").alias("model"), F.col("s_nationkey").alias("number")).distinct()
    return T.lookup(models, read(spark, d, "documents").where("source is not null").select(F.col("source").alias("name")).distinct())


@query(
    "model_citations",
    "WITH m AS (SELECT p_partkey AS model, p_brand || ', Brand#' || (p_size % 40)::varchar || ',' AS keys FROM part), e AS (SELECT model, trim(unnest(string_split(keys, ','))) AS key FROM m), c AS (SELECT p_brand AS key, min(p_name) AS text FROM part GROUP BY 1) "
    "SELECT model, key, coalesce(text, 'Reference not available') AS text FROM e LEFT JOIN c USING (key) WHERE key <> ''",
)
def _(spark, d):
    part = read(spark, d, "part")
    keys = F.concat("p_brand", F.lit(", Brand#"), (F.col("p_size") % 40).cast("string"), F.lit(","))
    return T.with_citations(part.select(F.col("p_partkey").alias("model"), keys.alias("keys")), part.groupBy(F.col("p_brand").alias("key")).agg(F.min("p_name").alias("text")))


@query("numeric_suffix", "SELECT DISTINCT source AS name, regexp_extract(source, '([0-9]+)$', 1)::bigint AS number FROM documents WHERE source IS NOT NULL ORDER BY number, name")
def _(spark, d):
    names = read(spark, d, "documents").where("source is not null").select(F.col("source").alias("name")).distinct()
    return names.withColumn("number", T.number_of("name")).orderBy("number", "name")


_SCORES = "s AS (SELECT o_orderpriority AS dataset, (month(o_orderdate) % 4)::int AS place, 'algo' || (month(o_orderdate) % 4)::varchar AS algo, max(o_totalprice) AS score FROM orders GROUP BY ALL)"


@query("best_algorithm", f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, place) AS k FROM s) SELECT dataset, algo, score FROM r WHERE k = 1")
def _(spark, d):
    place = (F.month("o_orderdate") % 4).cast("int")
    s = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), place.alias("place"), F.concat(F.lit("algo"), place.cast("string")).alias("algo")).agg(F.max("o_totalprice").alias("score"))
    return T.best(s, "dataset")


@query("ordinal_encode", "WITH c AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0 AND source IS NOT NULL)) SELECT doc_id, coalesce(code, -1)::int AS source FROM documents LEFT JOIN c USING (source)")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    # codes are fitted on the training rows and applied to all
    return T.ordinal_apply(docs, "source", T.ordinal_fit(docs.where("doc_id % 3 = 0"), "source"))


@query(
    "shuffle_rows",
    "WITH o AS (SELECT doc_id, md5('9:' || doc_id::varchar) AS k FROM documents) SELECT doc_id, (row_number() OVER (ORDER BY ('0x' || substr(k, 1, 4))::int % 256, k, doc_id) - 1)::bigint AS place FROM o",
)
def _(spark, d):
    return T.shuffled(read(spark, d, "documents").select("doc_id"), "doc_id", 9)


@query("subsample", "SELECT vec_id, label FROM embeddings ORDER BY md5('42:' || vec_id::varchar), vec_id LIMIT 500")
def _(spark, d):
    return T.subsample(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 500)


@query("stack_classes", "SELECT doc_id, quality, NULL::int AS toxic, 'good' AS class FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, NULL, toxic, 'toxic' FROM labels WHERE toxic = 1")
def _(spark, d):
    x = read(spark, d, "labels")
    return T.stacked({"good": x.where("quality = 1").select("doc_id", "quality"), "toxic": x.where("toxic = 1").select("doc_id", "toxic")}, "class").select("doc_id", "quality", "toxic", "class")


_GRID = "g AS (SELECT DISTINCT o_orderpriority AS dataset, unnest(range(1, 6))::int AS run FROM orders)"


@query("collect_runs", f"WITH {_GRID}, m AS (SELECT o_orderpriority AS dataset, (o_orderkey % 4)::int AS run, max(o_totalprice) AS score FROM orders GROUP BY ALL) SELECT dataset, run, score FROM g LEFT JOIN m USING (dataset, run)")
def _(spark, d):
    o = read(spark, d, "orders")
    grid = o.select(F.col("o_orderpriority").alias("dataset")).distinct().select("dataset", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("run"))
    return T.collect_runs(grid, o.groupBy(F.col("o_orderpriority").alias("dataset"), (F.col("o_orderkey") % 4).cast("int").alias("run")).agg(F.max("o_totalprice").alias("score")), ["dataset", "run"])


@query("strongest_pairs", f"WITH {LONG}, c AS (SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS c FROM x a JOIN x b ON a.id = b.id AND a.feature < b.feature GROUP BY 1, 2) SELECT f1, f2, c FROM c WHERE abs(c) >= 0.05 ORDER BY abs(c) DESC, f1, f2")
def _(spark, d):
    return T.strongest_pairs(X.pearson_pairs(X.feature_table(spark, d)), 0.05)


@query("importance_table", f"WITH {LONG} SELECT feature, round(var_pop(value), 6) AS importance FROM x GROUP BY feature ORDER BY importance DESC, feature")
def _(spark, d):
    return X.feature_table(spark, d).groupBy("feature").agg(F.round(F.var_pop("value"), 6).alias("importance")).orderBy(F.desc("importance"), "feature")


# evaluation

_ONE = "c AS (SELECT cls, sum((kind = 2)::int)::double AS tp, sum((kind = 0)::int)::double AS support, sum((kind = 1)::int)::double AS predicted FROM (SELECT real AS cls, 0 AS kind FROM p UNION ALL SELECT pred, 1 FROM p UNION ALL SELECT real, 2 FROM p WHERE real = pred) GROUP BY cls)"
Q["class_rates"] = lambda spark, d: E.class_rates(_p(spark, d))
SQL["class_rates"] = f"WITH {PRED}, {_ONE}, n AS (SELECT count(*)::double AS n FROM p) SELECT cls, round(tp / nullif(support, 0), 6) AS sensitivity, round((n - support - predicted + tp) / nullif(n - support, 0), 6) AS specificity, support::bigint AS support FROM c, n"
Q["report_averages"] = lambda spark, d: E.report_averages(_p(spark, d))
_PRF = f"{_ONE}, r AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"
SQL["report_averages"] = (
    f"WITH {PRED}, {_PRF} SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f "
    "UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM f "
    "UNION ALL SELECT 'micro', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6) FROM f"
)
Q["regression_folds"] = lambda spark, d: E.regression_by(read(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), (F.col("l_extendedprice") / 1000).alias("real"), (F.col("l_quantity") * 1.5).alias("pred")), "fold")
SQL["regression_folds"] = (
    "WITH p AS (SELECT l_orderkey % 5 AS fold, l_extendedprice / 1000 AS real, l_quantity * 1.5::double AS pred FROM lineitem) SELECT fold, round(avg(abs(real - pred)), 6) AS mae, round(avg((real - pred) * (real - pred)), 6) AS mse, "
    "round(sqrt(avg((real - pred) * (real - pred))), 6) AS rmse, round(1 - sum((real - pred) * (real - pred)) / (var_pop(real) * count(*)), 6) AS r2 FROM p GROUP BY fold"
)


@query("label_decode", "WITH c AS (SELECT lang, (dense_rank() OVER (ORDER BY lang) - 1)::int AS code FROM documents WHERE lang IS NOT NULL) SELECT doc_id, lang AS label FROM documents WHERE lang IN (SELECT lang FROM c)")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang").where("lang is not null")
    codes = T.ordinal_fit(docs, "lang")
    coded = T.ordinal_apply(docs, "lang", codes)
    return coded.join(F.broadcast(codes), F.col("lang") == F.col("code")).select("doc_id", F.col("value").alias("label"))


@query("oldest_pending", "SELECT user_id, min(ts) AS since FROM events GROUP BY user_id HAVING arg_max(event_type, ts::varchar || lpad(event_id::varchar, 12, '0')) <> (SELECT max(event_type) FROM events) ORDER BY since, user_id LIMIT 5")
def _(spark, d):
    e = read(spark, d, "events")
    done = e.agg(F.max("event_type").alias("done"))
    jobs = e.groupBy("user_id").agg(F.min("ts").alias("since"), F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    return jobs.join(F.broadcast(done)).where("x.event_type <> done").orderBy("since", "user_id").limit(5).select("user_id", "since")


# models: no SQL; pytest holds them against what they must keep to


def _rows(spark, d):
    e = read(spark, d, "embeddings").where("embedding is not null and label is not null")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").cast("int").alias("label"), F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(5)).cast("int").alias("fold"))


@query("model_predictions")
def _(spark, d):
    x = _rows(spark, d)
    found = M.apply(x.where("fold = 0"), M.fit(x.where("fold > 0")))
    return found.select("id", F.col("label").alias("real"), F.col("pred").cast("int").alias("pred"), F.round(F.array_max("probability"), 6).alias("probability"))


@query("model_folds")
def _(spark, d):
    return M.fold_metrics(M.cross_validated(_rows(spark, d), 5, "logistic"), 5)


@query("model_importances")
def _(spark, d):
    return M.importances(spark, M.fit(_rows(spark, d)))


@query("principal_components")
def _(spark, d):
    return M.principal_components(_rows(spark, d), 2).select("id", *[F.round(F.col("pc")[i], 6).alias(f"pc{i + 1}") for i in range(2)])


_GROUPS = {f"g{i}": list(range(16 * i, 16 * i + 16)) for i in range(4)}


@query("model_group_search")
def _(spark, d):
    _, trials = SE.group_search(_rows(spark, d), _GROUPS, ("logistic",), trials=6, folds=2, score="f1_weighted")
    return SE.trial_table(spark, trials)


@query("model_resamplers")
def _(spark, d):
    _, trials = SE.pick_resampler(_rows(spark, d).withColumn("fold", F.col("fold") % 2), "logistic")
    return SE.trial_table(spark, trials)


@query("model_algorithms")
def _(spark, d):
    _, trials = SE.pick_algorithm(_rows(spark, d).withColumn("fold", F.col("fold") % 2), ("forest", "logistic"), score="f1_weighted")
    return SE.trial_table(spark, trials)


@query("model_thresholds")
def _(spark, d):
    _, _, trials = SE.threshold_search(_rows(spark, d).withColumn("fold", F.col("fold") % 2), folds=2, most=3, score="f1_weighted")
    return SE.trial_table(spark, trials)


@query("model_regression")
def _(spark, d):
    o = read(spark, d, "lineitem").where("l_quantity is not null and l_extendedprice is not null")
    x = o.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")]).alias("features"), F.col("l_extendedprice").alias("label"))
    x = x.withColumn("fold", F.pmod(F.crc32("id"), F.lit(5)).cast("int"))
    return E.regression_by(M.cross_validated(x, 5, "linear", kind="regressor"), "fold")
