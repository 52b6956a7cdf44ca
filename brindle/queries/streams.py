"""Request limits, event windows and streaming jobs over the event log."""

from pyspark.sql import functions as F

from brindle.queries import query, rd
from brindle.queries.tables import REQUESTS, requests
from brindle.session import fresh_path
from brindle.sources.tables import client_key
from brindle.streaming import jobs as J
from brindle.streaming.limits import Limits, rate_limit_fixed, rate_limit_fixed_stream, rate_limit_sliding

# the log has a call every few minutes, so the windows are stretched to minutes, hours and days
WIDE = Limits(burst=(2, 600), minute=(5, 7200), hour=(30, 86400))
CALLS = "(SELECT event_id, event_type, epoch_us(ts) AS us FROM events)"
US = 1_000_000


def _frame(seconds, upto):
    return f"PARTITION BY event_type ORDER BY us RANGE BETWEEN {seconds * US if upto == 'used' else seconds * US - 1} PRECEDING AND {'CURRENT ROW' if upto else '1 PRECEDING'}"


SLIDING = f"""
WITH f AS (SELECT *, CASE WHEN lag(us) OVER (PARTITION BY event_type ORDER BY us, event_id) = us THEN 0 ELSE 1 END AS f FROM {CALLS}),
c AS (SELECT *, coalesce(sum(f) OVER ({_frame(600, None)}), 0) + 1 - f AS b, coalesce(sum(f) OVER ({_frame(7200, None)}), 0) + 1 - f AS m,
 coalesce(sum(f) OVER ({_frame(86400, None)}), 0) + 1 - f AS h, min(us) OVER ({_frame(7200, 'now')}) AS mo, min(us) OVER ({_frame(86400, 'now')}) AS ho,
 sum(f) OVER ({_frame(7200, 'used')}) AS mu, sum(f) OVER ({_frame(86400, 'used')}) AS hu FROM f),
r AS (SELECT *, CASE WHEN b >= 2 THEN 'burst' WHEN m >= 5 THEN 'minute' WHEN h >= 30 THEN 'hour' END AS reason FROM c)"""


def _sliding(t):
    return rate_limit_sliding(t.events.select("event_id", "event_type", "ts"), "event_type", "ts", "event_id", WIDE)


@query("rate_limit_sliding", f"""{SLIDING}
SELECT event_id, reason IS NOT NULL AS limited, reason, CAST(CASE reason WHEN 'burst' THEN 1 WHEN 'minute' THEN greatest(1, (7200000000 - (us - mo)) // {US})
 WHEN 'hour' THEN greatest(1, (86400000000 - (us - ho)) // {US}) END AS INTEGER) AS retry_after FROM r""")
def _(t):
    return _sliding(t).select(F.col("key").alias("event_id"), "limited", "reason", "retry_after")


@query("remaining_quota", f"{SLIDING} SELECT event_id, CAST(greatest(0, 5 - mu) AS INTEGER) AS minute_remaining, CAST(greatest(0, 30 - hu) AS INTEGER) AS hour_remaining FROM r")
def _(t):
    return _sliding(t).select(F.col("key").alias("event_id"), "minute_remaining", "hour_remaining")


# one recursion step per call: counters are reset by age, then the call is judged
FIXED = f"""
WITH RECURSIVE l AS (SELECT event_type, list(us ORDER BY us, event_id) AS t, list(event_id ORDER BY us, event_id) AS ids, count(*) AS n FROM {CALLS} GROUP BY 1),
s AS (SELECT event_type, CAST(0 AS BIGINT) AS i, NULL::BIGINT AS ms, 0 AS mc, NULL::BIGINT AS hs, 0 AS hc, []::BIGINT[] AS b, NULL::VARCHAR AS reason FROM l
 UNION ALL SELECT event_type, i, ms, CASE WHEN reason IS NULL THEN mc + 1 ELSE mc END, hs, CASE WHEN reason IS NULL THEN hc + 1 ELSE hc END,
  CASE WHEN reason IS NULL THEN list_append(b, now) ELSE b END, reason FROM (
  SELECT *, CASE WHEN len(b) >= 2 THEN 'burst' WHEN mc >= 5 THEN 'minute' WHEN hc >= 30 THEN 'hour' END AS reason FROM (
   SELECT s.event_type, s.i + 1 AS i, l.t[s.i + 1] AS now, CASE WHEN ms IS NULL OR l.t[s.i + 1] - ms > 7200000000 THEN l.t[s.i + 1] ELSE ms END AS ms,
    CASE WHEN ms IS NULL OR l.t[s.i + 1] - ms > 7200000000 THEN 0 ELSE mc END AS mc, CASE WHEN hs IS NULL OR l.t[s.i + 1] - hs > 86400000000 THEN l.t[s.i + 1] ELSE hs END AS hs,
    CASE WHEN hs IS NULL OR l.t[s.i + 1] - hs > 86400000000 THEN 0 ELSE hc END AS hc, list_filter(b, lambda x: l.t[s.i + 1] - x < 600000000) AS b
   FROM s JOIN l ON l.event_type = s.event_type WHERE s.i < l.n)))
SELECT l.ids[s.i] AS event_id, reason IS NOT NULL AS limited, reason FROM s JOIN l ON l.event_type = s.event_type WHERE s.i > 0"""


@query("rate_limit_fixed", FIXED)
def _(t):
    out = rate_limit_fixed(t.events, "event_type", "ts", "event_id", WIDE, slice_seconds=10 * 86400)
    return out.select(F.col("key").alias("event_id"), "limited", "reason")


@query("rate_limit_fixed_stream", FIXED)
def _(t):
    stream = J.file_stream(t.spark, t.stream_path("events"), t.events.schema)
    verdicts = rate_limit_fixed_stream(stream, "event_type", "ts", "event_id", WIDE)
    out = J.run_available(verdicts, fresh_path(t.spark, "verdicts"), fresh_path(t.spark, "verdicts-log"))
    return out.select(F.col("key").alias("event_id"), "limited", "reason")


@query("client_key", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN 'peer' || user_id WHEN 2 THEN 'unknown' ELSE 'peer' || user_id END AS client FROM events""")
def _(t):
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    forwarded = F.when(k == 0, F.concat(F.lit(" 10.0.0."), user, F.lit(" , 192.168.0.1"))).when(k == 3, " ")
    host = F.when(k != 2, F.concat(F.lit("peer"), user))
    return t.events.select("event_id", client_key(forwarded, host).alias("client"))


STAMP = "'%Y-%m-%d %H:%M:%S'"


def _stamped(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")})


TUMBLING = f"""SELECT strftime(date_trunc('hour', ts), {STAMP}) AS window_start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, {STAMP}) AS window_end,
 event_type, count(*) AS n, {rd('sum(value)', 2)} AS total FROM events"""


@query("events_tumbling", f"{TUMBLING} GROUP BY date_trunc('hour', ts), event_type")
def _(t):
    return _stamped(J.window_counts(J.with_time(t.events, "ts"), "ts", ["event_type"], "value"))


@query("events_sliding", f"""
WITH e AS (SELECT *, unnest(range(0, 6)) AS back FROM events), w AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) - back * INTERVAL 10 MINUTE AS s FROM e)
SELECT strftime(s, {STAMP}) AS window_start, strftime(s + INTERVAL 1 HOUR, {STAMP}) AS window_end, event_type, count(*) AS n, {rd('sum(value)', 2)} AS total FROM w GROUP BY s, event_type""")
def _(t):
    return _stamped(J.window_counts(J.with_time(t.events, "ts"), "ts", ["event_type"], "value", "1 hour", "10 minutes"))


@query("events_tumbling_stream", f"""{TUMBLING} WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
 GROUP BY date_trunc('hour', ts), event_type""")
def _(t):
    stream = J.with_time(J.file_stream(t.spark, t.stream_path("events"), t.events.schema), "ts").withWatermark("ts", J.WATERMARK)
    counts = J.window_counts(stream, "ts", ["event_type"], "value")
    return _stamped(J.run_available(counts, fresh_path(t.spark, "hours"), fresh_path(t.spark, "hours-log")))


@query("index_sync", "SELECT vec_id, label, len(embedding) AS dimensions FROM embeddings")
def _(t):
    path = fresh_path(t.spark, "index")
    stream = J.file_stream(t.spark, t.stream_path("embeddings"), t.embeddings.schema)
    J.index_sync(stream, path, fresh_path(t.spark, "index-log"), "vec_id", "embedding", ["label"])
    return t.spark.read.parquet(path).select("vec_id", "label", F.col("dimensions").cast("bigint").alias("dimensions"))


@query("audit_stream", f"""
SELECT request_id, path, status_code, {rd('duration_ms', 2)} AS duration_ms,
 CASE WHEN status_code >= 500 THEN 'error' WHEN status_code >= 400 THEN 'warning' ELSE 'info' END AS severity FROM {REQUESTS} WHERE path <> '/health'""")
def _(t):
    events = J.file_stream(t.spark, t.stream_path("events"), t.events.schema)
    rows = J.audit_stream(requests(events), "ts", "request_id")
    return J.run_available(rows, fresh_path(t.spark, "audit"), fresh_path(t.spark, "audit-log")).drop("ts")
