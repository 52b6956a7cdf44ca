"""Totals at several levels, set operations, semi and anti joins, whole-table ranks and mergeable counts."""

from pyspark.sql import functions as F

from brindle.operators import sketches as S
from brindle.operators.grouping import cube_sets, grouping_sets, rollup_sets
from brindle.operators.ranking import global_ranks
from brindle.operators.sets import anti_join, except_all, intersect_all, semi_join
from brindle.queries import query, rd
from brindle.session import fresh_path

MEASURES = {"n": ("count", None), "total": ("sum", "l_extendedprice"), "mean": ("avg", "l_quantity"), "least": ("min", "l_discount"), "most": ("max", "l_tax")}
AGGREGATES = f"count(*) AS n, {rd('sum(l_extendedprice)', 2)} AS total, {rd('avg(l_quantity)', 2)} AS mean, min(l_discount) AS least, max(l_tax) AS most"
# A status that is missing for some rows, to tell NULL groups from subtotals.
LINES = "(SELECT *, nullif(l_linestatus, 'F') AS status FROM lineitem)"


def _lines(t):
    return t.lineitem.withColumn("status", F.nullif("l_linestatus", F.lit("F")))


@query("cube_totals", f"""SELECT l_returnflag, status, l_linenumber, CAST(grouping(l_returnflag) AS INTEGER) AS total_l_returnflag, CAST(grouping(status) AS INTEGER) AS total_status,
 CAST(grouping(l_linenumber) AS INTEGER) AS total_l_linenumber, CAST(grouping(l_returnflag) + grouping(status) + grouping(l_linenumber) AS INTEGER) AS level, {AGGREGATES}
 FROM {LINES} GROUP BY CUBE (l_returnflag, status, l_linenumber)""")
def _(t):
    keys = ["l_returnflag", "status", "l_linenumber"]
    return grouping_sets(_lines(t), keys, cube_sets(keys), MEASURES)


@query("rollup_totals", f"""SELECT status, l_returnflag, CAST(grouping(status) AS INTEGER) AS total_status, CAST(grouping(l_returnflag) AS INTEGER) AS total_l_returnflag,
 CAST(grouping(status) + grouping(l_returnflag) AS INTEGER) AS level, {AGGREGATES} FROM {LINES} GROUP BY ROLLUP (status, l_returnflag)""")
def _(t):
    keys = ["status", "l_returnflag"]
    return grouping_sets(_lines(t), keys, rollup_sets(keys), MEASURES)


@query("grouping_sets_having", f"""SELECT l_suppkey, status, CAST(grouping(l_suppkey) AS INTEGER) AS total_l_suppkey, CAST(grouping(status) AS INTEGER) AS total_status,
 CAST(grouping(l_suppkey) + grouping(status) AS INTEGER) AS level, {AGGREGATES} FROM {LINES} GROUP BY GROUPING SETS ((l_suppkey, status), (l_suppkey), ())
 HAVING count(*) > 20 AND avg(l_quantity) > 25.005""")
def _(t):
    sets = [("l_suppkey", "status"), ("l_suppkey",), ()]
    return grouping_sets(_lines(t), ["l_suppkey", "status"], sets, MEASURES, (F.col("n") > 20) & (F.col("mean") > 25.0))


PAIR = "SELECT l_returnflag AS flag, nullif(l_linestatus, 'F') AS status, l_linenumber % 3 AS k"


def _pair(df):
    return df.select(F.col("l_returnflag").alias("flag"), F.nullif("l_linestatus", F.lit("F")).alias("status"), (F.col("l_linenumber") % 3).alias("k"))


@query("intersect_all", f"{PAIR} FROM lineitem WHERE l_quantity > 25 INTERSECT ALL {PAIR} FROM lineitem WHERE l_discount > 0.05")
def _(t):
    return intersect_all(_pair(t.lineitem.filter("l_quantity > 25")), _pair(t.lineitem.filter("l_discount > 0.05")))


@query("except_all", f"{PAIR} FROM lineitem WHERE l_quantity > 25 EXCEPT ALL {PAIR} FROM lineitem WHERE l_discount > 0.05")
def _(t):
    return except_all(_pair(t.lineitem.filter("l_quantity > 25")), _pair(t.lineitem.filter("l_discount > 0.05")))


# Customers and suppliers as keys with holes.
CUST = "(SELECT c_custkey, nullif(c_nationkey, 3) AS nation, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer)"


def _customers(t):
    return t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))


def _rich(t):
    return t.supplier.filter("s_acctbal > 8000").select(F.nullif("s_nationkey", F.lit(5)).alias("home"))


RICH = "SELECT nullif(s_nationkey, 5) AS home FROM supplier WHERE s_acctbal > 8000"


@query("semi_join", f"SELECT c_custkey FROM {CUST} c WHERE EXISTS (SELECT 1 FROM ({RICH}) WHERE home = nation)")
def _(t):
    return semi_join(_customers(t), _rich(t), [("nation", "home")]).select("c_custkey")


@query("anti_join_not_exists", f"SELECT c_custkey FROM {CUST} c WHERE NOT EXISTS (SELECT 1 FROM ({RICH}) WHERE home = nation)")
def _(t):
    return anti_join(_customers(t), _rich(t), [("nation", "home")]).select("c_custkey")


@query("anti_join_not_in", f"SELECT c_custkey FROM {CUST} c WHERE nation NOT IN (SELECT home FROM ({RICH}) WHERE home IS NOT NULL)")
def _(t):
    return anti_join(_customers(t), _rich(t).filter("home IS NOT NULL"), [("nation", "home")], "not_in").select("c_custkey")


@query("anti_join_not_in_null", f"SELECT c_custkey FROM {CUST} c WHERE nation NOT IN (SELECT home FROM ({RICH}) UNION ALL SELECT NULL)")
def _(t):
    """One NULL on the right leaves nothing."""
    holes = _rich(t).unionByName(t.spark.range(1).select(F.lit(None).cast("int").alias("home")))
    return anti_join(_customers(t), holes, [("nation", "home")], "not_in").select("c_custkey")


@query("anti_join_not_in_pairs", f"""WITH r AS (SELECT nullif(c_nationkey, 4) AS home, c_mktsegment AS part FROM customer WHERE c_acctbal > 9900)
SELECT c_custkey FROM {CUST} c WHERE NOT EXISTS (SELECT 1 FROM r WHERE (nation = home OR nation IS NULL OR home IS NULL) AND (segment = part OR segment IS NULL OR part IS NULL))""")
def _(t):
    """NOT IN over two columns: a comparison that is unknown counts against the row."""
    right = t.customer.filter("c_acctbal > 9900").select(F.nullif("c_nationkey", F.lit(4)).alias("home"), F.col("c_mktsegment").alias("part"))
    return anti_join(_customers(t), right, [("nation", "home"), ("segment", "part")], "not_in").select("c_custkey")


RANKS = """rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist"""


@query("global_ranks", f"""SELECT l_orderkey, l_linenumber, {RANKS} FROM lineitem WINDOW w AS (ORDER BY l_quantity)""")
def _(t):
    """Fifty values over all lines: ties far longer than a range."""
    ranked = global_ranks(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])
    return ranked.select("l_orderkey", "l_linenumber", "rank", "dense_rank", *[F.round(c, 9).alias(c) for c in ("percent_rank", "cume_dist")])


@query("global_ranks_desc", f"""SELECT o_orderkey, row_number() OVER v AS row_number, {RANKS}, CAST(ntile(7) OVER v AS INTEGER) AS ntile
 FROM (SELECT o_orderkey, o_orderdate, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
 WINDOW w AS (ORDER BY p DESC NULLS LAST, o_orderdate DESC), v AS (ORDER BY p DESC NULLS LAST, o_orderdate DESC, o_orderkey)""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    ranked = global_ranks(rows, ["p", "o_orderdate"], True, ["o_orderkey"], 7)
    return ranked.select("o_orderkey", "row_number", "rank", "dense_rank", "ntile", *[F.round(c, 9).alias(c) for c in ("percent_rank", "cume_dist")])


@query("distinct_by_span")
def _(t):
    """Distinct users of a span of days with bounds, from sketches stored per day and kind of event."""
    return _span(t, "user_id")


def _span(t, column):
    path = fresh_path(t.spark, "sketches")
    S.append_sketches(t.events, path, F.date_format("ts", "yyyy-MM-dd"), [column], ["event_type"])
    span = S.read_sketches(t.spark, path).filter("month BETWEEN '2024-01-05' AND '2024-01-20'")
    return S.distinct_counts(span, [column], ["event_type"])


@query("distinct_bounds", """SELECT event_type, count(*) AS rows, true AS within FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY event_type""")
def _(t):
    """Whether the exact count lies within the bounds of the estimate."""
    days = F.date_format("ts", "yyyy-MM-dd").between("2024-01-05", "2024-01-20")
    exact = t.events.filter(days).groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return _span(t, "user_id").join(exact, "event_type").select("event_type", "rows", F.col("exact").between(F.col("user_id_low"), F.col("user_id_high")).alias("within"))
