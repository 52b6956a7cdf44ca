"""Sessions, late events and committed output over the event log."""

from datetime import timedelta

from pyspark.sql import functions as F

from brindle.queries import query, rd
from brindle.session import fresh_path
from brindle.streaming import jobs as J
from brindle.streaming.late import LATE, ON_TIME, LateSplit, late_schema, read_committed
from brindle.streaming.sessions import session_stream, sessions

GAP = timedelta(minutes=30)
SESSIONS = f"""
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
d AS (SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n, {rd('sum(value)', 2)} AS total FROM s GROUP BY user_id, session)
SELECT user_id, epoch_us(session_start) AS session_start, epoch_us(last_event) AS last_event, n, total FROM d"""


def _micros(df):
    return df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("session_start", "last_event")})


@query("events_session", SESSIONS)
def _(t):
    return _micros(sessions(t.events.select("user_id", "ts", "value"), "user_id", "ts", "value", GAP))


@query("events_session_hot", SESSIONS.replace("user_id", "event_type").replace("30 MINUTE", "5 MINUTE"))
def _(t):
    """Five entities, each with a fifth of the events."""
    return _micros(sessions(t.events.select("event_type", "ts", "value"), "event_type", "ts", "value", timedelta(minutes=5)))


@query("events_session_stream", f"{SESSIONS} WHERE last_event + INTERVAL 30 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def _(t):
    stream = J.with_time(J.file_stream(t.spark, t.stream_path("events"), t.events.schema), "ts")
    closed = session_stream(stream, "user_id", "ts", "value", GAP, J.WATERMARK)
    return _micros(J.run_available(closed, fresh_path(t.spark, "sessions"), fresh_path(t.spark, "sessions-log")))


# Events arrive in four batches, by the last hexadecimal digit of the md5 of their number: a quarter each, so most come late.
ARRIVAL = "SELECT *, (strpos('0123456789abcdef', right(md5(CAST(event_id AS VARCHAR)), 1)) - 1) // 4 AS arrival FROM events"
LATENESS = f"""
WITH a AS ({ARRIVAL}), m AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a GROUP BY arrival),
l AS (SELECT event_id, arrival, (epoch_us(seen) - epoch_us(ts)) / 1000000 - 20 * 86400 AS lateness FROM a JOIN m USING (arrival))"""


def _arrived(t):
    """The two tables that the late split makes of the events, dealt into four files that are read one by one."""
    digit = F.instr(F.lit("0123456789abcdef"), F.right(F.md5(F.col("event_id").cast("string")), F.lit(1))) - 1
    waiting, out = fresh_path(t.spark, "arrivals"), fresh_path(t.spark, "late-split")
    rows = t.events.withColumn("arrival", F.floor(digit / 4).cast("int"))
    for n in range(4):
        rows.filter(F.col("arrival") == n).drop("arrival").coalesce(1).write.mode("append").parquet(waiting)
    stream = J.file_stream(t.spark, waiting, t.events.schema, files_per_batch=1)
    LateSplit(out, "ts", timedelta(days=20)).start(stream, fresh_path(t.spark, "late-log"))
    return out


@query("late_events", f"{LATENESS} SELECT event_id, arrival AS batch_id, CAST(lateness AS DOUBLE) AS lateness_seconds FROM l WHERE lateness > 0")
def _(t):
    out = _arrived(t)
    return read_committed(t.spark, out, LATE, late_schema(t.events.schema)).select("event_id", "batch_id", "lateness_seconds")


@query("on_time_events", f"{LATENESS} SELECT event_id, arrival AS batch_id FROM l WHERE lateness IS NULL OR lateness <= 0")
def _(t):
    out = _arrived(t)
    return read_committed(t.spark, out, ON_TIME, t.events.schema).select("event_id", "batch_id")
