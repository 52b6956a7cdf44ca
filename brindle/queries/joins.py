"""Joins by order and range over the event log, the orders and the parts."""

from datetime import timedelta

from pyspark.sql import functions as F

from brindle.operators.joins import asof_join, interval_join, range_join
from brindle.queries import query


@query("asof_join", """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, max(event_id) AS seen_id, arg_max(value, event_id) AS seen_value FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, v.seen_id, v.seen_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def _(t):
    """The last view of the user before each purchase."""
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return asof_join(bought, seen, "ts", "at", ["user_id"], ["seen_id", "seen_value"], ties=["seen_id"]).drop("ts")


@query("asof_join_forward", """
WITH s AS (SELECT l_linestatus, l_shipdate, min(ROW(l_orderkey, l_linenumber)) AS k FROM lineitem GROUP BY ALL)
SELECT o_orderkey, CASE WHEN l_shipdate - o_orderdate <= INTERVAL 2 DAY THEN k[1] END AS next_key, CASE WHEN l_shipdate - o_orderdate <= INTERVAL 2 DAY THEN k[2] END AS next_line
FROM orders ASOF LEFT JOIN s ON o_orderstatus = l_linestatus AND o_orderdate <= l_shipdate""")
def _(t):
    """The next shipment of the same status within two days: three entities, days full of ties."""
    shipped = t.lineitem.select(F.col("l_linestatus").alias("o_orderstatus"), "l_shipdate", F.col("l_orderkey").alias("next_key"), F.col("l_linenumber").alias("next_line"))
    return asof_join(
        t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), shipped, "o_orderdate", "l_shipdate", ["o_orderstatus"],
        ["next_key", "next_line"], ties=["next_key", "next_line"], direction="forward", tolerance=timedelta(days=2)).select("o_orderkey", "next_key", "next_line")


@query("asof_join_nearest", """
WITH v AS (SELECT ts, max(event_id) AS i FROM events WHERE event_type = 'error' GROUP BY ts), w AS (SELECT ts, min(event_id) AS i FROM events WHERE event_type = 'error' GROUP BY ts),
s AS (SELECT event_id, ts FROM events WHERE event_type = 'signup'),
b AS (SELECT s.event_id, s.ts, v.i, s.ts - v.ts AS d FROM s ASOF LEFT JOIN v ON s.ts >= v.ts), a AS (SELECT s.event_id, w.i, w.ts - s.ts AS d FROM s ASOF LEFT JOIN w ON s.ts <= w.ts)
SELECT b.event_id, CASE WHEN b.i IS NULL OR (a.i IS NOT NULL AND a.d < b.d) THEN a.i ELSE b.i END AS error_id FROM b JOIN a USING (event_id)""")
def _(t):
    """The error closest in time to each signup, all rows one entity."""
    errors = t.events.filter("event_type = 'error'").select(F.col("ts").alias("at"), F.col("event_id").alias("error_id"))
    signups = t.events.filter("event_type = 'signup'").select("event_id", "ts")
    return asof_join(signups, errors, "ts", "at", columns=["error_id"], ties=["error_id"], direction="nearest").drop("ts")


# An error is felt for as many seconds as the square of its value, which makes few very long spans among many short ones.
FELT = "SELECT event_id AS error_id, user_id AS error_user, ts AS since, ts + to_microseconds(CAST(floor(value * value * 1000000) AS BIGINT)) AS until FROM events WHERE event_type = 'error'"


def _felt(t):
    length = F.make_dt_interval(secs=F.floor(F.col("value") * F.col("value") * 1_000_000).cast("decimal(18,0)") / 1_000_000)
    return t.events.filter("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), F.col("user_id").alias("error_user"), F.col("ts").alias("since"), (F.col("ts") + length).alias("until"))


@query("range_join", f"""
WITH felt AS ({FELT})
SELECT error_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events JOIN felt ON ts >= since AND ts < until WHERE event_type = 'purchase' GROUP BY error_id""")
def _(t):
    """Purchases while an error was felt."""
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "ts")
    pairs = range_join(bought, _felt(t), "ts", "since", "until", closed="left")
    return pairs.groupBy("error_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("range_join_left", f"""
WITH felt AS ({FELT})
SELECT event_id, error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') LEFT JOIN felt ON user_id = error_user AND ts BETWEEN since AND until""")
def _(t):
    """Every purchase with the errors its user felt then, if any."""
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return range_join(bought, _felt(t), "ts", "since", "until", [("user_id", "error_user")], how="left", key=["event_id"]).select("event_id", "error_id")



@query("interval_join", f"""
WITH felt AS ({FELT}), signed AS (SELECT event_id AS signup_id, ts AS opened, ts + to_microseconds(CAST(floor(value * 60 * 1000000) AS BIGINT)) AS closed FROM events WHERE event_type = 'signup')
SELECT signup_id, count(*) AS n, min(error_id) AS first_id, max(error_id) AS last_id FROM signed JOIN felt ON opened <= until AND since <= closed GROUP BY signup_id""")
def _(t):
    """Errors felt during the minutes that each signup took."""
    length = F.make_dt_interval(secs=F.floor(F.col("value") * 60 * 1_000_000).cast("decimal(18,0)") / 1_000_000)
    signed = t.events.filter("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), F.col("ts").alias("opened"), (F.col("ts") + length).alias("closed"))
    pairs = interval_join(signed, _felt(t), "opened", "closed", "since", "until")
    return pairs.groupBy("signup_id").agg(F.count("*").alias("n"), F.min("error_id").alias("first_id"), F.max("error_id").alias("last_id"))


@query("interval_join_by", """
SELECT p.p_partkey AS part_a, q.p_partkey AS part_b FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_partkey < q.p_partkey
 AND p.p_retailprice - p.p_size / 100.0 <= q.p_retailprice + q.p_size / 100.0 AND q.p_retailprice - q.p_size / 100.0 <= p.p_retailprice + p.p_size / 100.0""")
def _(t):
    """Parts of one brand whose price bands overlap."""
    def side(mark):
        width = F.col("p_size") / 100.0
        return t.part.select(F.col("p_partkey").alias(f"part_{mark}"), F.col("p_brand").alias(f"brand_{mark}"), (F.col("p_retailprice") - width).alias(f"low_{mark}"),
                             (F.col("p_retailprice") + width).alias(f"high_{mark}"))

    pairs = interval_join(side("a"), side("b"), "low_a", "high_a", "low_b", "high_b", [("brand_a", "brand_b")])
    return pairs.filter("part_a < part_b").select("part_a", "part_b")
