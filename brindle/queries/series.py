"""Time-series features on daily event totals and on single orders."""

from pyspark.sql import functions as F

from brindle.operators import series as S
from brindle.queries import query, rd

# raw orders per priority: few entities with many rows each, so positions cross many ranges
SORTED = "PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey"
KEYS = ("o_orderkey", "o_orderpriority")
BLOCK = 500


def _orders(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")


def _daily(t):
    """Events per type and day: at most one row per day, whatever the log's size."""
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.round(F.sum("value").cast("decimal(38,8)"), 2).cast("double").alias("total")
    )


DAILY = f"(SELECT event_type, CAST(ts AS DATE) AS day, {rd('sum(value)', 2)} AS total FROM events GROUP BY 1, 2)"


@query("calendar_features", """
SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
 CAST(year(o_orderdate) AS INTEGER) AS year, CAST(day(o_orderdate) AS INTEGER) AS day_of_month, CAST(week(o_orderdate) AS INTEGER) AS week_of_year,
 CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN day(o_orderdate) = 1 THEN 1 ELSE 0 END AS is_month_start,
 CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN 1 ELSE 0 END AS is_month_end FROM orders""")
def _(t):
    return S.calendar_features(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("seq_index", """
SELECT o_orderkey, strftime(DATE '2026-01-01' + CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS INTEGER), '%Y-%m-%d') AS date_index FROM orders""")
def _(t):
    out = S.seq_index(t.orders, ["o_orderpriority"], [F.asc("o_orderkey")])
    return out.select("o_orderkey", F.date_format("date_index", "yyyy-MM-dd").alias("date_index"))


@query("lag_features", f"""
SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS lag_1, lag(o_totalprice, 7) OVER w AS lag_7, lag(o_totalprice, 30) OVER w AS lag_30
FROM orders WINDOW w AS ({SORTED})""")
def _(t):
    out = S.lag_features(_orders(t), ["o_orderpriority"], "o_orderdate", "o_totalprice", ties=["o_orderkey"], block=BLOCK)
    return out.select("o_orderkey", "lag_1", "lag_7", "lag_30")


@query("rolling_features", f"""
SELECT o_orderkey, {rd(f'avg(o_totalprice) OVER ({SORTED} ROWS 6 PRECEDING)', 4)} AS rolling_mean_7,
 {rd(f'avg(o_totalprice) OVER ({SORTED} ROWS 29 PRECEDING)', 4)} AS rolling_mean_30,
 {rd(f'stddev_samp(o_totalprice) OVER ({SORTED} ROWS 6 PRECEDING)', 3)} AS rolling_std_7 FROM orders""")
def _(t):
    out = S.rolling_features(_orders(t), ["o_orderpriority"], "o_orderdate", "o_totalprice", ties=["o_orderkey"], block=BLOCK)
    return out.select("o_orderkey", *[
        S.round_to(F.col(c), d).alias(c) for c, d in (("rolling_mean_7", 4), ("rolling_mean_30", 4), ("rolling_std_7", 3))
    ])


HOLES = "(SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)"


@query("pct_change", f"""
WITH f AS (SELECT o_orderkey, o_orderpriority, o_orderdate, last_value(v IGNORE NULLS) OVER ({SORTED} ROWS UNBOUNDED PRECEDING) AS filled FROM {HOLES})
SELECT o_orderkey, {rd(f'filled / lag(filled) OVER ({SORTED}) - 1', 6)} AS pct_change FROM f""")
def _(t):
    holes = _orders(t).withColumn("v", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    out = S.pct_change(holes, ["o_orderpriority"], "o_orderdate", "v", ties=["o_orderkey"], block=BLOCK)
    return out.select("o_orderkey", S.round_to(F.col("pct_change"), 6).alias("pct_change"))


MONTHLY = """(SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, round(CAST(sum(o_totalprice) AS DECIMAL(38,8)), 2)::DOUBLE AS total FROM orders GROUP BY 1, 2)"""
FIT = f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) - 1 AS x FROM {MONTHLY}),
f AS (SELECT o_orderpriority, count(*) AS n, regr_slope(total, x) AS slope, regr_r2(total, x) AS r2, avg(total) AS mean, stddev_pop(total) / avg(total) AS cv FROM p GROUP BY 1),
d AS (SELECT *, slope / mean AS rel, CASE WHEN cv > 0.5 THEN 'volatile' WHEN abs(slope / mean) < 0.01 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM f)
SELECT o_orderpriority, n, {rd('slope', 3)} AS slope, {rd('r2', 6)} AS r2, {rd('cv', 6)} AS cv, direction,
 {rd("CASE direction WHEN 'volatile' THEN least(cv, 1.0) WHEN 'stable' THEN 1 - abs(rel) * 10 ELSE least(abs(rel) * 10, 1.0) END", 6)} AS strength FROM d"""


def _monthly(t):
    return t.orders.groupBy("o_orderpriority", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("m")).agg(
        F.round(F.sum("o_totalprice").cast("decimal(38,8)"), 2).cast("double").alias("total")
    )


def _fit(t):
    fit = S.trend_fit(_monthly(t), ["o_orderpriority"], "m", "total")
    digits = {"slope": 3, "r2": 6, "cv": 6, "strength": 6}
    return fit.withColumns({c: S.round_to(F.col(c), d) for c, d in digits.items()})


@query("trend_fit", FIT)
def _(t):
    return _fit(t)


@query("trend_summary", f"""
WITH t AS ({FIT}) SELECT o_orderpriority, 'Based on ' || n || ' data points, the trend is ' || direction || CASE
 WHEN direction IN ('increasing', 'decreasing') THEN ' with ' || CAST(round(CAST(strength * 100 AS DECIMAL(38,8)), 0) AS BIGINT) || '% confidence. R² fit: ' || printf('%.3f', round(CAST(r2 AS DECIMAL(38,8)), 3))
  || '. Slope: ' || printf('%.4f', round(CAST(slope AS DECIMAL(38,8)), 4)) || ' per period'
 WHEN direction = 'volatile' THEN '. High variability detected (CV > 50%)' ELSE '' END AS summary FROM t""")
def _(t):
    return S.trend_summary(_fit(t)).select("o_orderpriority", "summary")


@query("change_points", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n,
 avg(total) OVER f AS mean, stddev_samp(total) OVER f AS sd FROM {DAILY} WINDOW f AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, total, pos, {rd('abs(total - mean) / sd', 4)} AS z FROM p
WHERE n >= 15 AND pos >= 5 AND pos < n - 1 AND sd > 0 AND abs(total - mean) / sd > 2""")
def _(t):
    return S.change_points(_daily(t), ["event_type"], "day", "total").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
