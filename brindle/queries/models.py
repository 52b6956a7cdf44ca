"""Coding, splitting, training, scoring, anomalies and the version table."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from brindle.functions.numbers import round_to
from brindle.functions.predicates import target_flag
from brindle.operators import anomaly as A
from brindle.operators import models as M
from brindle.operators import registry as G
from brindle.operators.schema import schema_score, semantic_types
from brindle.operators.series import trend_fit
from brindle.operators.stats import chart_importance, combo_means, risk_summary
from brindle.queries import query, rd
from brindle.queries.statistics import SCORED, scored
from brindle.session import fresh_path, written

_trained: dict = {}


def forget() -> None:
    """Drop the fits kept for the queries of one folder."""
    _trained.clear()


def account(t):
    """Orders with their customer's segment, the size of the order and whether any of its lines came back."""
    joined = t.wide("orders", "o_orderkey").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("back"))
    sized = joined.join(lines, "o_orderkey", "left")
    return sized.select(
        "o_orderkey", F.col("o_totalprice").alias("total"), F.month("o_orderdate").alias("month"), F.col("c_acctbal").alias("balance"),
        F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.when(F.col("back") == 1, "Yes").otherwise("No").alias("outcome"),
    )


CATEGORICAL, NUMERIC = ["priority", "segment"], ["total", "month", "balance", "lines", "quantity"]


def trained(t, algorithm="random_forest"):
    """One fit per data folder and algorithm; the queries below only score with it."""
    key = (t.spark.sparkContext.applicationId, t.folder, algorithm)
    if key not in _trained:
        _trained[key] = M.train_classifier(account(t), "outcome", ["o_orderkey"], algorithm, CATEGORICAL, NUMERIC)
    return _trained[key]


@query("encode_labels", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority_encoded,
 CAST(dense_rank() OVER (ORDER BY coalesce(nullif(o_orderstatus, 'P'), 'Unknown')) - 1 AS BIGINT) AS status_encoded FROM orders""")
def _(t):
    holes = t.orders.select("o_orderkey", "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return M.encode_labels(holes, ["o_orderpriority", "status"]).select("o_orderkey", "o_orderpriority_encoded", "status_encoded")


@query("numeric_prep", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS price FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    stages, _ = M.numeric_stages([], ["price"])
    prepared = PipelineModel(stages).transform(t.orders.select("o_orderkey", text.alias("price")))
    return prepared.select("o_orderkey", vector_to_array("features")[0].alias("price"))


@query("split_stratified", """
WITH h AS (SELECT o_orderkey, o_orderstatus, md5('42:' || o_orderkey) AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderstatus) AS total FROM h)
SELECT o_orderkey, n <= floor(total * 0.8 + 0.5) AS is_train FROM r""")
def _(t):
    return M.split_stratified(t.orders, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "is_train")


@query("classifier_metrics", f"""
WITH c AS (SELECT count(*) FILTER (label=1 AND score>=0.5) AS tp, count(*) FILTER (label=0 AND score<0.5) AS tn,
 count(*) FILTER (label=0 AND score>=0.5) AS fp, count(*) FILTER (label=1 AND score<0.5) AS fn FROM {SCORED}),
m AS (SELECT *, CAST(tp AS DOUBLE)/(tp+fp) AS p, CAST(tp AS DOUBLE)/(tp+fn) AS r FROM c),
k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM {SCORED}),
a AS (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS auc FROM k)
SELECT tp, tn, fp, fn, {rd('CAST(tp+tn AS DOUBLE)/(tp+tn+fp+fn)', 4)} AS accuracy, {rd('p', 4)} AS precision, {rd('r', 4)} AS recall, {rd('2*p*r/(p+r)', 4)} AS f1, {rd('auc', 4)} AS auc FROM m, a""")
def _(t):
    return M.classifier_metrics(scored(t), "label", "score")


@query("overfit_alert", "SELECT count(*) FILTER (l_returnflag = 'R') AS tp, 0 AS fp, true AS alert FROM lineitem")
def _(t):
    leaked = scored(t).withColumn("score", F.col("label").cast("double"))
    out = M.overfit_alert(M.classifier_metrics(leaked, "label", "score"))
    return out.select("tp", F.col("fp").cast("int").alias("fp"), "alert")


# What a fit finds cannot be said in SQL; tests/test_models.py walks the trees in plain Python instead.

@query("train_rf")
def _(t):
    return trained(t).metrics


@query("train_gbt")
def _(t):
    return trained(t, "gradient_boosting").metrics


# Rows of the split, which SQL can say: as many as the measures of the fit are taken from.
@query("train_rf_split", """
WITH y AS (SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'R'), false) AS y FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || o_orderkey), o_orderkey) AS n, count(*) OVER (PARTITION BY y) AS total FROM y)
SELECT count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, 7 AS features_used, 'outcome' AS target FROM r WHERE n > floor(total * 0.8 + 0.5)""")
def _(t):
    return trained(t).metrics.select(
        (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"), "features_used", "target")


@query("feature_importance")
def _(t):
    return M.feature_importance(trained(t))


@query("rank_importance")
def _(t):
    return M.rank_importance(M.feature_importance(trained(t)))


@query("chart_importance")
def _(t):
    return chart_importance(M.feature_importance(trained(t)))


@query("score_batch")
def _(t):
    return M.score_batch(trained(t), account(t), ["o_orderkey"])


@query("score_rows")
def _(t):
    return M.score_rows(trained(t), account(t).drop("outcome", "balance", "segment"), ["o_orderkey"])


@query("rank_predictions", f"""
SELECT l_orderkey, l_linenumber, score FROM (SELECT l_orderkey, l_linenumber, {rd('l_discount * 10', 3)} AS score FROM lineitem)""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", round_to(F.col("l_discount") * 10, 3).alias("probability"))
    return M.rank_predictions(rows, ["l_orderkey", "l_linenumber"]).withColumnRenamed("probability", "score")


@query("join_pred_actual")
def _(t):
    # both sides read the rows, which are made once
    rows = written(account(t), "accounts")
    predictions = M.score_batch(trained(t), rows, ["o_orderkey"]).select("o_orderkey", "probability")
    labels = rows.select("o_orderkey", target_flag(rows, "outcome").cast("int").alias("actual"))
    return predictions.join(labels, "o_orderkey").select("o_orderkey", "actual", "probability")


@query("risk_of_model")
def _(t):
    return risk_summary(M.score_batch(trained(t), account(t), ["o_orderkey"]), "probability")


@query("model_save", "SELECT 'outcome' AS target, 7 AS features, count(*) AS rows FROM orders")
def _(t):
    path = fresh_path(t.spark, "model")
    M.save_model(trained(t), path)
    loaded = M.load_model(t.spark, path)
    scored_rows = M.score_batch(loaded, account(t), ["o_orderkey"]).agg(F.count("probability").alias("rows"))
    return scored_rows.select(F.lit(loaded.target).alias("target"), F.lit(len(loaded.features)).alias("features"), "rows")


@query("model_load", "SELECT o_orderkey, true AS same FROM orders")
def _(t):
    path = fresh_path(t.spark, "model")
    M.save_model(trained(t), path)
    rows = written(account(t), "accounts")
    again = M.score_batch(M.load_model(t.spark, path), rows, ["o_orderkey"]).select("o_orderkey", F.col("probability").alias("p"))
    first = M.score_batch(trained(t), rows, ["o_orderkey"])
    return first.join(again, "o_orderkey").select("o_orderkey", (F.abs(F.col("p") - F.col("probability")) < 1e-12).alias("same"))


def billing(t):
    return t.wide("lineitem", "l_partkey").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("enterprise"), F.col("l_partkey").alias("subaccount"),
        F.col("l_returnflag").alias("device"), F.col("l_linestatus").alias("service"), F.col("l_quantity").alias("bandwidth"),
        F.col("l_extendedprice").alias("rate"), "l_shipdate",
    )


def rate_model(t):
    key = (t.spark.sparkContext.applicationId, t.folder, "rate")
    if key not in _trained:
        _trained[key] = M.train_rate_regressor(
            billing(t), ["l_orderkey", "l_linenumber"], "rate", ["enterprise", "subaccount", "device", "service"], ["bandwidth"]
        )
    return _trained[key]


@query("train_rate_regressor")
def _(t):
    return rate_model(t).metrics


@query("rate_regressor_rows", """SELECT count(*) AS total_records, CAST(floor(count(*) * 0.8 + 0.5) AS BIGINT) AS train_records,
 count(*) - CAST(floor(count(*) * 0.8 + 0.5) AS BIGINT) AS test_records, count(DISTINCT l_suppkey) AS unique_enterprise, count(DISTINCT l_partkey) AS unique_subaccount FROM lineitem""")
def _(t):
    """What of the fit's report SQL can say."""
    return rate_model(t).metrics.drop("train_r2", "test_r2")


@query("score_rate")
def _(t):
    return M.score_rate(rate_model(t), billing(t), ["l_orderkey", "l_linenumber"])


@query("rate_gap")
def _(t):
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    combos = combo_means(billing(t), ["enterprise", "subaccount"], ["device", "service"], ["bandwidth", "rate"], order)
    return M.rate_gap(rate_model(t), combos, ["enterprise", "subaccount"], "rate")


# Anomalies

COLS = ("o_totalprice", "spread")


def _priced(t):
    return t.wide("orders", "o_orderkey").select("o_orderkey", "o_totalprice", (F.pow(F.col("o_totalprice") / 100000, F.lit(4.0))).alias("spread"))


PRICED = "(SELECT o_orderkey, o_totalprice, pow(o_totalprice / 100000, 4.0) AS spread FROM orders)"
ZHITS = f"""
WITH s AS (SELECT avg(o_totalprice) AS m1, stddev_samp(o_totalprice) AS s1, avg(spread) AS m2, stddev_samp(spread) AS s2 FROM {PRICED}),
z AS (SELECT o_orderkey, o_totalprice, spread, abs((o_totalprice - m1) / s1) AS z1, abs((spread - m2) / s2) AS z2 FROM {PRICED}, s),
h AS (SELECT o_orderkey, CASE WHEN z1 > 2.1 THEN 'o_totalprice' ELSE 'spread' END AS col, CASE WHEN z1 > 2.1 THEN o_totalprice ELSE spread END AS value,
 CASE WHEN z1 > 2.1 THEN z1 ELSE z2 END AS score FROM z WHERE z1 > 2.1 OR z2 > 2.1)"""


@query("anomaly_zscore", f"""{ZHITS} SELECT o_orderkey, col AS "column", {rd('value', 4)} AS value, {rd('score', 6)} AS score,
 CASE WHEN score > 4 THEN 'high' WHEN score > 3.5 THEN 'medium' ELSE 'low' END AS severity FROM h""")
def _(t):
    out = A.anomaly_zscore(_priced(t), ["o_orderkey"], list(COLS), 2.1)
    return out.withColumns({"value": round_to(F.col("value"), 4), "score": round_to(F.col("score"), 6)})


@query("dedup_first", f"""{ZHITS} SELECT o_orderkey, col AS "column" FROM h""")
def _(t):
    hits = A.zscores(_priced(t), ["o_orderkey"], list(COLS), 2.1)
    return A.dedup_first(hits, ["o_orderkey"]).select("o_orderkey", "column")


@query("rank_anomalies", f"""{ZHITS} SELECT o_orderkey, {rd('score', 6)} AS score FROM h""")
def _(t):
    hits = A.anomaly_zscore(_priced(t), ["o_orderkey"], list(COLS), 2.1)
    return A.rank_anomalies(hits, ["o_orderkey"]).select("o_orderkey", round_to(F.col("score"), 6).alias("score"))


@query("anomaly_report", f"""{ZHITS}, c AS (SELECT count(*) AS anomalies, count(*) FILTER (score > 4) AS high, (SELECT count(*) FROM orders) AS total FROM h)
SELECT anomalies, high, total, {rd('100.0 * anomalies / total', 1)} AS percent, 'Z-Score' AS method,
 'Found ' || anomalies || ' anomalies (' || printf('%.1f', round(CAST(100.0 * anomalies / total AS DECIMAL(38,8)), 1)) || '%) using Z-Score' AS summary FROM c""")
def _(t):
    hits = A.anomaly_zscore(_priced(t), ["o_orderkey"], list(COLS), 2.1)
    return A.anomaly_report(hits, t.orders.agg(F.count("*")).scalar(), "Z-Score")


@query("anomaly_iqr", f"""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a1, quantile_cont(o_totalprice, 0.75) AS b1, quantile_cont(spread, 0.25) AS a2, quantile_cont(spread, 0.75) AS b2 FROM {PRICED}),
x AS (SELECT o_orderkey, o_totalprice, spread, greatest(a1 - 1.5 * (b1 - a1) - o_totalprice, o_totalprice - b1 - 1.5 * (b1 - a1)) AS d1,
 greatest(a2 - 1.5 * (b2 - a2) - spread, spread - b2 - 1.5 * (b2 - a2)) AS d2 FROM {PRICED}, q)
SELECT o_orderkey, CASE WHEN d1 > 0 THEN 'o_totalprice' ELSE 'spread' END AS "column", {rd('CASE WHEN d1 > 0 THEN d1 ELSE d2 END', 4)} AS beyond FROM x WHERE d1 > 0 OR d2 > 0""")
def _(t):
    out = A.anomaly_iqr(_priced(t), ["o_orderkey"], list(COLS))
    return out.select("o_orderkey", "column", round_to(F.col("beyond"), 4).alias("beyond"))


@query("anomaly_iforest")
def _(t):
    return A.anomaly_iforest(_priced(t), ["o_orderkey"], list(COLS))


FINGERPRINT = """left(md5(sum(CAST(('0x' || substr(md5({0}), 1, 15)) AS BIGINT)::HUGEINT)::VARCHAR || ':' || count(*)), 8)"""


@query("retrain_registry", f"""
WITH p AS (SELECT {FINGERPRINT.format("o_orderkey || '|' || o_totalprice")} AS h, count(*) AS n FROM orders)
SELECT 'v1_' || h AS version, h AS training_data_hash, CAST(n AS DOUBLE) AS rows FROM p
UNION ALL SELECT 'v2_' || h, h, CAST(n AS DOUBLE) FROM p""")
def _(t):
    rows = _priced(t).select("o_orderkey", "o_totalprice")
    first = G.retrain(G.empty_registry(t.spark), rows, ["o_orderkey"], ["o_totalprice"])
    second = G.retrain(G.written(first, "registry"), rows, ["o_orderkey"], ["o_totalprice"])
    return second.select("version", "training_data_hash", F.col("metrics")["n"].alias("rows"))


@query("rollback_scores")
def _(t):
    """All rows scored by the version that was rolled back to."""
    rows = _priced(t)
    first = G.retrain(G.empty_registry(t.spark), rows, ["o_orderkey"], ["o_totalprice"])
    both = G.written(G.retrain(G.written(first, "registry"), rows, ["o_orderkey"], list(COLS)), "registry")
    back = G.rollback(both, both.filter("version LIKE 'v1%'").first()["version"])
    return A.score_with(G.active_forest(back), rows, ["o_orderkey"])


STEPS = """WITH v AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) AS n, count(*) AS rows FROM orders GROUP BY 1)"""


@query("registry_rollback", f"""{STEPS} SELECT 'v' || n || '_' || left(p, 1) AS version, n = 2 AS is_active FROM v""")
def _(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("n"))
    place = F.substring("o_orderpriority", 1, 1)
    versions = counts.select(
        F.concat(F.lit("v"), place, F.lit("_"), place).alias("version"), F.lit("").alias("model_path"),
        F.create_map(F.lit("std_score"), F.col("n")).alias("metrics"), F.current_timestamp().alias("created_at"),
        place.alias("training_data_hash"), (place == "5").alias("is_active"),
    )
    return G.rollback(versions, "v2_2").select("version", "is_active")


@query("retrain_eval")
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
    schema = schema_score(semantic_types(df, "o_orderkey"), df).select(F.lit("schema_accuracy").alias("measure"), F.col("accuracy").alias("value"))
    monthly = df.groupBy("o_orderpriority", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("m")).agg(F.sum("o_totalprice").alias("v"))
    trends = trend_fit(monthly, ["o_orderpriority"], "m", "v").agg(F.count("*").cast("double").alias("value")).select(F.lit("trends_fitted").alias("measure"), "value")
    hits = A.anomaly_iforest(_priced(t), ["o_orderkey"], list(COLS))
    precision = hits.agg((F.try_divide(F.count_if(F.col("severity") == "high"), F.count("*")) * 100).alias("value")).select(F.lit("anomaly_precision").alias("measure"), "value")
    return schema.unionByName(trends).unionByName(precision)
