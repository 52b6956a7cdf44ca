"""Tables behind the charts."""

from pyspark.sql import functions as F

from brindle.operators import stats
from brindle.queries import query, rd
from brindle.queries.statistics import CONFUSION, HISTOGRAM, SCORED, account, order_account, scored


@query("chart_distribution", """
SELECT 'total' AS measure, count(*) AS n FROM lineitem UNION ALL SELECT 'positive', count(*) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'retained', count(*) FROM lineitem WHERE l_returnflag <> 'R'""")
def _(t):
    return stats.chart_distribution(account(t), "churn_label")


@query("chart_category", f"""
WITH a AS (SELECT o_orderpriority, c_mktsegment, o_orderstatus='F' AS f FROM orders JOIN customer ON o_custkey=c_custkey),
g AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS category, f FROM a UNION ALL SELECT 'c_mktsegment', c_mktsegment, f FROM a),
r AS (SELECT "column", left(category, 15) AS label, count(*) AS total, {rd("100.0*sum(CASE WHEN f THEN 1 ELSE 0 END)/count(*)", 1)} AS rate FROM g GROUP BY 1, 2)
SELECT *, CASE WHEN rate >= 30 THEN 'high' WHEN rate >= 20 THEN 'medium' ELSE 'low' END AS band FROM r""")
def _(t):
    return stats.chart_category(order_account(t), "churn_label", ["o_orderpriority", "c_mktsegment"])


@query("chart_risk", f"""
SELECT 'risk' AS part, CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS label, count(*) AS n FROM {SCORED} GROUP BY 2
UNION ALL SELECT * FROM ({HISTOGRAM} SELECT 'histogram', lpad(CAST(bin AS VARCHAR), 2, '0'), count(*) FROM b GROUP BY bin)""")
def _(t):
    return stats.chart_risk(scored(t), "score")


@query("chart_confusion", f"""
SELECT * FROM ({CONFUSION} SELECT unnest(['tp', 'tn', 'fp', 'fn', 'accuracy', 'precision', 'recall', 'f1']) AS measure,
 unnest([CAST(tp AS DOUBLE), tn, fp, fn, {rd('CAST(tp+tn AS DOUBLE)/(tp+tn+fp+fn)', 4)}, {rd('p', 4)}, {rd('r', 4)}, {rd('2*p*r/(p+r)', 4)}]) AS value FROM m)""")
def _(t):
    wide = stats.confusion(scored(t), "label", "score")
    typed = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
    return typed.unpivot([], typed.columns, "measure", "value")
