"""The documented question shapes over orders, customers and line items."""

from pyspark.sql import functions as F

from brindle.functions.predicates import non_blank
from brindle.plans import shapes
from brindle.queries import query, rd
from brindle.queries.statistics import SCORED, scored



def final():
    return F.col("o_orderstatus") == "F"


def returned():
    return F.col("l_returnflag") == "R"


N_F = "count(*) FILTER (o_orderstatus = 'F')"


@query("q_count", "SELECT count(*) AS n FROM orders")
def _(t):
    return shapes.count_where(t.orders)


@query("q_rate", f"SELECT count(*) AS total, {N_F} AS positive, {rd(f'100.0*{N_F}/count(*)', 2)} AS rate FROM orders")
def _(t):
    return shapes.rate(t.orders, final())


@query("q_avg", f"SELECT {rd('avg(l_quantity)', 2)} AS average FROM lineitem")
def _(t):
    return shapes.average(t.lineitem, "l_quantity")


def _by_nation(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


@query("q_group_count", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def _(t):
    return shapes.group_count(_by_nation(t), ["n_name"])


@query("q_group_rate_desc", f"SELECT o_orderpriority, count(*) AS total, {N_F} AS positive, {rd(f'100.0*{N_F}/count(*)', 2)} AS rate FROM orders GROUP BY 1")
def _(t):
    return shapes.group_rate(t.orders, final(), ["o_orderpriority"])


@query("q_topn_groups", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 10")
def _(t):
    return shapes.group_count(t.customer, ["c_nationkey"], 10)


@query("q_distribution", f"SELECT c_mktsegment, count(*) AS n, {rd('100.0*count(*)/(SELECT count(*) FROM customer)', 2)} AS share FROM customer GROUP BY 1")
def _(t):
    return shapes.distribution(t.customer, "c_mktsegment")


@query("q_flag_count", "SELECT count(*) AS n FROM lineitem WHERE l_linestatus = 'O'")
def _(t):
    return shapes.count_where(t.lineitem, F.col("l_linestatus") == "O")


@query("q_flag_percent", f"""SELECT {rd("100.0*count(*) FILTER (l_linestatus = 'O')/count(*)", 2)} AS percent FROM lineitem""")
def _(t):
    return shapes.percent_where(t.lineitem, F.col("l_linestatus") == "O")


@query("q_argmax_group", f"""
SELECT o_orderpriority, count(*) AS total, {N_F} AS positive, {rd(f'100.0*{N_F}/count(*)', 2)} AS rate
FROM orders GROUP BY 1 ORDER BY rate DESC, 1 LIMIT 1""")
def _(t):
    return shapes.group_rate(t.orders, final(), ["o_orderpriority"], 1)


@query("q_threshold_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def _(t):
    return shapes.count_where(t.orders, F.col("o_totalprice") > 100000)


@query("q_recent_window", """
SELECT count(*) FILTER (o_orderstatus = 'F') AS n FROM orders
WHERE CAST(o_orderdate AS DATE) >= CAST((SELECT max(o_orderdate) FROM orders) AS DATE) - INTERVAL 3 MONTH""")
def _(t):
    latest = t.orders.agg(F.max("o_orderdate")).scalar()
    return shapes.recent_positive(t.orders, final(), "o_orderdate", latest)


@query("q_rate_filtered", f"""
SELECT count(*) AS total, count(*) FILTER (l_returnflag='R') AS positive,
  {rd("100.0*count(*) FILTER (l_returnflag='R')/count(*)", 2)} AS rate FROM lineitem WHERE l_quantity < 12""")
def _(t):
    return shapes.rate(t.lineitem, returned(), F.col("l_quantity") < 12)


@query("q_high_risk_count", f"SELECT count(*) AS n FROM {SCORED} WHERE score > 0.7")
def _(t):
    return shapes.count_where(scored(t), F.col("score") > 0.7)


@query("q_multi_flag", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag='R' AND l_linestatus='O' AND l_tax > 0")
def _(t):
    return shapes.count_where(t.lineitem, returned(), F.col("l_linestatus") == "O", F.col("l_tax") > 0)


@query("q_compare_groups", f"""
WITH g AS (SELECT avg(o_totalprice) FILTER (o_orderstatus='F') AS a, avg(o_totalprice) FILTER (o_orderstatus<>'F') AS b FROM orders)
SELECT {rd('a', 2)} AS with_flag, {rd('b', 2)} AS without_flag, {rd('a-b', 2)} AS difference FROM g""")
def _(t):
    return shapes.compare_groups(t.orders, final(), "o_totalprice")


@query("q_sum_by_group", f"""
SELECT n_name, {rd('sum(o_totalprice)', 2)} AS sum_value
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1""")
def _(t):
    # totals per customer first, so the joins carry one row per customer and not one per order
    per_customer = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("value"))
    located = per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return shapes.group_value(located, ["n_name"], "value", "sum")


@query("q_avg_by_group", f"SELECT l_linestatus, {rd('avg(l_quantity)', 2)} AS avg_value FROM lineitem GROUP BY 1")
def _(t):
    return shapes.group_value(t.lineitem, ["l_linestatus"], "l_quantity", "avg")


@query("q_two_key_rate", f"""
SELECT o_orderpriority, c_mktsegment, count(*) AS total, {N_F} AS positive, {rd(f'100.0*{N_F}/count(*)', 2)} AS rate
FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1, 2""")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return shapes.group_rate(joined, final(), ["o_orderpriority", "c_mktsegment"])


@query("filter_nonblank", "SELECT count(*) AS n FROM (SELECT nullif(l_linestatus, 'F') AS s, CASE WHEN l_linenumber=3 THEN '' ELSE l_returnflag END AS r FROM lineitem) WHERE s IS NOT NULL AND s <> '' AND r IS NOT NULL AND r <> ''")
def _(t):
    holes = t.lineitem.select(
        F.nullif("l_linestatus", F.lit("F")).alias("s"),
        F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("l_returnflag")).alias("r"),
    )
    return shapes.count_where(holes, non_blank(F.col("s")), non_blank(F.col("r")))


@query("filter_positive", "SELECT count(*) AS n FROM lineitem WHERE l_tax > 0")
def _(t):
    return shapes.count_where(t.lineitem, F.col("l_tax") > 0)
