"""Aggregations and reports over the order and line-item tables."""

from pyspark.sql import functions as F

from brindle.operators import stats
from brindle.plans.spec import LIST_LIMIT, QuerySpec, run_spec
from brindle.queries import query, rd

PCT = "100.0 * {0} / {1}"


def account(t):
    """Line items with a Yes/No outcome column."""
    return t.lineitem.withColumn("churn_label", F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No"))


def order_account(t):
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.withColumn("churn_label", F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No"))


def scored(t):
    """Line items with a score between 0 and 1 and a 0/1 outcome."""
    return t.lineitem.select(
        (F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label")
    )


SCORED = "(SELECT l_discount * 10 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"


@query("count_all", "SELECT count(*) AS count FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def _(t):
    spec = QuerySpec(agg="COUNT", filters=(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F"))
    return run_spec(t.orders, spec)


@query("agg_round", f"""
SELECT 'SUM' AS agg, {rd('sum(o_totalprice)', 2)} AS value FROM orders
UNION ALL SELECT 'AVG', {rd('avg(o_totalprice)', 2)} FROM orders
UNION ALL SELECT 'MIN', {rd('min(o_totalprice)', 2)} FROM orders
UNION ALL SELECT 'MAX', {rd('max(o_totalprice)', 2)} FROM orders""")
def _(t):
    parts = [
        run_spec(t.orders, QuerySpec(agg=a, column="o_totalprice")).toDF("value").select(F.lit(a).alias("agg"), "value")
        for a in ("SUM", "AVG", "MIN", "MAX")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("group_count", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def _(t):
    return run_spec(t.orders, QuerySpec(agg="COUNT", group_by=("o_orderpriority",)))


@query("group_agg", f"SELECT o_orderpriority, {rd('avg(o_totalprice)', 2)} AS avg_o_totalprice FROM orders GROUP BY 1")
def _(t):
    return run_spec(t.orders, QuerySpec(agg="AVG", column="o_totalprice", group_by=("o_orderpriority",)))


@query("summary_stats", f"""
SELECT count(*) AS total, CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) AS positive,
  {rd("100.0 * sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) / count(*)", 1)} AS rate,
  {', '.join(f"{rd(f'avg({c})', 2)} AS avg_{c}" for c in ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))}
FROM lineitem""")
def _(t):
    return stats.summary_stats(account(t), "churn_label")


@query("summary_text", """
SELECT count(*) AS total, CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) AS positive,
  printf('%.1f', round(CAST(100.0 * sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) / count(*) AS DECIMAL(38,8)), 1)) || '%' AS rate,
  format('{:,.2f}', CAST(round(CAST(avg(l_quantity) AS DECIMAL(38,8)), 2) AS DOUBLE)) AS avg_l_quantity,
  '$' || format('{:,.2f}', CAST(round(CAST(avg(l_extendedprice) AS DECIMAL(38,8)), 2) AS DOUBLE)) AS avg_l_extendedprice
FROM lineitem""")
def _(t):
    return stats.summary_text(stats.summary_stats(account(t), "churn_label", ["l_quantity", "l_extendedprice"]))


@query("category_rate", f"""
WITH a AS (SELECT o_orderpriority, c_mktsegment, o_orderstatus='F' AS f FROM orders JOIN customer ON o_custkey=c_custkey),
g AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS category, f FROM a
      UNION ALL SELECT 'c_mktsegment', c_mktsegment, f FROM a)
SELECT "column", category, count(*) AS total, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS positive,
  {rd("100.0*sum(CASE WHEN f THEN 1 ELSE 0 END)/count(*)", 1)} AS rate
FROM g GROUP BY 1, 2""")
def _(t):
    return stats.category_rate(order_account(t), "churn_label", ["o_orderpriority", "c_mktsegment"])


@query("category_count", """
WITH g AS (SELECT 'p_brand' AS "column", p_brand AS category FROM part UNION ALL SELECT 'p_type', p_type FROM part),
c AS (SELECT "column", category, count(*) AS total FROM g GROUP BY 1, 2)
SELECT "column", category, total FROM c""")
def _(t):
    return stats.category_count(t.part, ["p_brand", "p_type"])


@query("category_pick", """
WITH g AS (SELECT 'p_name' AS "column", p_name AS category FROM part UNION ALL SELECT 'p_brand', p_brand FROM part
  UNION ALL SELECT 'p_type', p_type FROM part)
SELECT "column", category, count(*) AS total FROM g GROUP BY 1, 2""")
def _(t):
    return stats.category_count(t.part, stats.pick_categories(t.part))


@query("corpus_stats", """
SELECT count(*) AS chunks, count(DISTINCT source) AS files,
  strftime(min(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER))), '%Y-%m-%d %H:%M:%S') AS first_upload,
  strftime(max(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER))), '%Y-%m-%d %H:%M:%S') AS last_upload
FROM documents""")
def _(t):
    chunks = t.documents.select("source", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, doc_id, 0, 0)").alias("upload_date"))
    out = stats.corpus_stats(chunks, "source", "upload_date")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_upload", "last_upload")})


def _days(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_upload", "last_upload")})


SPAN = "strftime(min(l_shipdate), '%Y-%m-%d') AS first_upload, strftime(max(l_shipdate), '%Y-%m-%d') AS last_upload"


@query("billing_summary", f"""
SELECT l_suppkey, l_partkey, count(*) AS records, {rd('avg(l_extendedprice)', 2)} AS avg_rate,
  {rd('sum(l_extendedprice)', 2)} AS total_rate, {rd('avg(l_quantity)', 2)} AS avg_bandwidth, {SPAN}
FROM lineitem GROUP BY 1, 2""")
def _(t):
    return _days(stats.billing_summary(t.lineitem, ["l_suppkey", "l_partkey"], "l_extendedprice", "l_quantity", "l_shipdate"))


@query("billing_stats", f"""
SELECT count(*) AS records, count(DISTINCT l_suppkey) AS distinct_l_suppkey, count(DISTINCT l_partkey) AS distinct_l_partkey,
  {rd('avg(l_extendedprice)', 2)} AS avg_rate, {rd('min(l_extendedprice)', 2)} AS min_rate,
  {rd('max(l_extendedprice)', 2)} AS max_rate, {rd('sum(l_extendedprice)', 2)} AS total_rate, {SPAN} FROM lineitem""")
def _(t):
    return _days(stats.billing_stats(t.lineitem, ["l_suppkey", "l_partkey"], "l_extendedprice", "l_shipdate"))


@query("combo_means", f"""
SELECT l_suppkey, l_partkey,
  struct_extract(min(struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, v := l_returnflag)), 'v') AS l_returnflag,
  struct_extract(min(struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, v := l_linestatus)), 'v') AS l_linestatus,
  {rd('avg(l_quantity)', 4)} AS l_quantity, {rd('avg(l_extendedprice)', 4)} AS l_extendedprice
FROM lineitem GROUP BY 1, 2""")
def _(t):
    out = stats.combo_means(
        t.lineitem, ["l_suppkey", "l_partkey"], ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"],
        F.struct("l_shipdate", "l_orderkey", "l_linenumber"),
    )
    return out.withColumns({c: stats.round_to(F.col(c), 4) for c in ("l_quantity", "l_extendedprice")})


@query("group_nunique", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts")
    )


@query("risk_summary", f"""
SELECT count(*) AS total, count(*) FILTER (score >= 0.7) AS high_risk, count(*) FILTER (score >= 0.4 AND score < 0.7) AS medium_risk,
  count(*) FILTER (score < 0.4) AS low_risk, {rd('100.0 * count(*) FILTER (score >= 0.7) / count(*)', 1)} AS high_share FROM {SCORED}""")
def _(t):
    return stats.risk_summary(scored(t), "score")


CONFUSION = f"""
WITH c AS (SELECT count(*) FILTER (label=1 AND score>=0.5) AS tp, count(*) FILTER (label=0 AND score<0.5) AS tn,
  count(*) FILTER (label=0 AND score>=0.5) AS fp, count(*) FILTER (label=1 AND score<0.5) AS fn FROM {SCORED}),
m AS (SELECT *, CAST(tp AS DOUBLE)/(tp+fp) AS p, CAST(tp AS DOUBLE)/(tp+fn) AS r FROM c)"""


@query("confusion", f"""{CONFUSION}
SELECT tp, tn, fp, fn, {rd('CAST(tp+tn AS DOUBLE)/(tp+tn+fp+fn)', 4)} AS accuracy, {rd('p', 4)} AS precision, {rd('r', 4)} AS recall,
  {rd('2*p*r/(p+r)', 4)} AS f1 FROM m""")
def _(t):
    return stats.confusion(scored(t), "label", "score")


HISTOGRAM = f"""
WITH e AS (SELECT min(score) AS lo, max(score) AS hi FROM {SCORED}),
b AS (SELECT least(CAST(floor(20.0 * (score - lo) / (hi - lo)) AS INTEGER) + 1, 20) AS bin, lo, (hi - lo) / 20 AS width FROM {SCORED}, e)"""


@query("prob_histogram", f"{HISTOGRAM} SELECT bin, count(*) AS n, {rd('lo + (bin - 1) * width', 6)} AS bin_start FROM b GROUP BY bin, lo, width")
def _(t):
    return stats.prob_histogram(scored(t), "score")


@query("score_stats", f"""
SELECT {rd('avg(CASE WHEN score < 0.1 THEN 1.0 ELSE 0.0 END)', 6)} AS anomaly_rate, {rd('avg(score)', 6)} AS mean_score,
  {rd('stddev_pop(score)', 6)} AS std_score, count(*) AS n FROM {SCORED}""")
def _(t):
    return stats.score_stats(scored(t), "score", F.col("score") < 0.1)


# Sorts and limits

@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return run_spec(t.orders, QuerySpec(columns=("o_orderkey", "o_totalprice"), order_by="o_totalprice", limit=10, ties=("o_orderkey",)))


@query("bottom_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def _(t):
    spec = QuerySpec(columns=("o_orderkey", "o_totalprice"), order_by="o_totalprice", desc=False, limit=25, ties=("o_orderkey",))
    return run_spec(t.orders, spec)


@query("list_limit", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {LIST_LIMIT}")
def _(t):
    """The rows of a listing without a limit of its own, under a total order."""
    ordered = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey")
    return run_spec(ordered, QuerySpec(columns=("o_orderkey", "o_totalprice"), limit=LIST_LIMIT))


@query("top_groups", """
WITH c AS (SELECT l_partkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS positive FROM lineitem GROUP BY 1)
SELECT 'l_partkey' AS "column", CAST(l_partkey AS VARCHAR) AS category, total, positive FROM c ORDER BY total DESC, category LIMIT 15""")
def _(t):
    return stats.category_rate(account(t), "churn_label", ["l_partkey"], 15).drop("rate")
