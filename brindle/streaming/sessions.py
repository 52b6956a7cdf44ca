"""Sessions: runs of events of one user without a longer gap, from a table or a stream."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import round_to
from brindle.operators.joins import in_ranges

SESSION = ("session_start", "last_event", "n", "total")


def _continued(rows: DataFrame, user: str, carried: DataFrame, column: str) -> DataFrame:
    """``column`` of ``carried`` added to rows of a user that an earlier range has begun.

    Ranges are sorted by user, so only the first user of a range continues: ``carried`` has one row per range at most.
    """
    table = carried.filter(F.col(column).isNotNull()).select(F.col(user).alias("_u"), F.col("_range").alias("_rangec"), column)
    return rows.join(F.broadcast(table), F.col(user).eqNullSafe(F.col("_u")) & (F.col("_range") == F.col("_rangec")), "left").drop("_u", "_rangec")


def numbered(events: DataFrame, user: str, ts: str, gap: timedelta) -> DataFrame:
    """Events with ``session``, the number of the user's session from 1 on.

    An event more than ``gap`` after the user's event before it opens a session; NULL users are one user, events without a time belong to none
    and are left out. Events are dealt into ranges of (user, time); a range takes over when the user was last seen and how many sessions there
    were, so a user with any share of the events is spread over many tasks.
    """
    dealt = in_ranges(events.filter(F.col(ts).isNotNull()), [F.asc(user), F.asc(ts)])
    earlier = Window.partitionBy(user).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.groupBy(user, "_range").agg(F.max(ts).alias("_end"))
    rows = _continued(dealt, user, seen.select(user, "_range", F.max("_end").over(earlier).alias("_before")), "_before")
    within = Window.partitionBy(user, "_range").orderBy(ts)
    previous = F.coalesce(F.lag(ts).over(within), F.col("_before"))
    opens = (previous.isNull() | (F.col(ts) - previous > F.lit(gap))).cast("long")
    rows = rows.withColumn("_opens", opens).drop("_before")
    begun = rows.groupBy(user, "_range").agg(F.sum("_opens").alias("_begun"))
    rows = _continued(rows, user, begun.select(user, "_range", F.sum("_begun").over(earlier).alias("_sessions")), "_sessions")
    # events of one time share a session whatever their order: the frame goes by time
    so_far = F.sum("_opens").over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("session", so_far + F.coalesce("_sessions", F.lit(0))).drop("_opens", "_sessions", "_range")


def sessions(events: DataFrame, user: str, ts: str, value: str, gap: timedelta) -> DataFrame:
    """(user, session_start, last_event, n, total) of every session; its events are summed before they are shuffled."""
    rows = numbered(events, user, ts, gap)
    return rows.groupBy(user, "session").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("last_event"), F.count("*").alias("n"), round_to(F.sum(value), 2).alias("total")
    ).drop("session")


def session_stream(events: DataFrame, user: str, ts: str, value: str, gap: timedelta, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """The same rows from a stream, each once its session can no longer grow: ``late`` after ``gap`` has passed since its last event.

    Micro-batches that overlap a session merge into its state, in whatever order they come. Events of a session are merged
    in the task that reads them before anything is shuffled, so a user with many events sends one row per session and task.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    # a window ends where an event no longer joins it; an event exactly ``gap`` after another still does
    seconds = f"{gap // timedelta(microseconds=1) + 1} microseconds"
    window = F.session_window(F.col(ts), seconds)
    grouped = events.withWatermark(ts, late).groupBy(window.alias("w"), user, *keys).agg(
        F.max(ts).alias("last_event"), F.count("*").alias("n"), round_to(F.sum(value), 2).alias("total"))
    return grouped.select(user, *keys, F.col("w.start").alias("session_start"), "last_event", "n", "total")
