"""Limits against a call-by-call replay, and streams against their tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.session import fresh_path
from brindle.streaming import jobs as J
from brindle.streaming.limits import SECOND, Limits, rate_limit_fixed, rate_limit_fixed_stream, rate_limit_sliding


def calls(spark, rows):
    df = spark.createDataFrame([(c, i, int(us)) for i, (c, us) in enumerate(rows)], "client string, id int, us bigint")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def replay_sliding(rows, limits):
    seen, out = {}, {}
    for i, (c, now) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        past = seen.setdefault(c, set())
        prior = [sum(1 for t in past if now - s * SECOND < t) for _, s in (limits.burst, limits.minute, limits.hour)]
        reasons = [n for n, p, (m, _) in zip(("burst", "minute", "hour"), prior, (limits.burst, limits.minute, limits.hour)) if p >= m]
        out[i] = reasons[0] if reasons else None
        past.add(now)
    return out


def replay_fixed(rows, limits):
    """Counts recomputed from the list of accepted calls; a window is only a start time."""
    accepted, starts, out = {}, {}, {}
    for i, (c, now) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        mine = accepted.setdefault(c, [])
        broken = ["burst"] if sum(now - t < limits.burst[1] * SECOND for t, _ in mine) >= limits.burst[0] else []
        for name, (most, seconds) in (("minute", limits.minute), ("hour", limits.hour)):
            begun, _ = starts.get((c, name), (None, None))
            if begun is None or now - begun > seconds * SECOND:
                starts[c, name] = (now, i)
            opened = starts[c, name]
            if sum((t, k) >= opened for t, k in mine) >= most:
                broken.append(name)
        out[i] = broken[0] if broken else None
        if not broken:
            mine.append((now, i))
    return out


def noise(n=3000, seed=2):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 2 * 86400 * SECOND, n))
    at = np.concatenate((at, 86400 * SECOND + rng.integers(0, 900, 600) * SECOND // 10 * 10))
    who = np.where(rng.random(len(at)) < 0.6, "hot", rng.choice(["a", "b", "c"], len(at)))
    return list(zip(who.tolist(), at.tolist()))


SMALL = Limits(burst=(2, 5), minute=(4, 300), hour=(12, 3600))
RULES = [
    [("c", i * SECOND // 20) for i in range(11)],
    [("c", i * SECOND * 59 // 61) for i in range(61)],
    [("c", i * 60 * SECOND) for i in range(200)],
]


@pytest.mark.parametrize("rows, limits", [(r, Limits()) for r in RULES] + [(noise(), SMALL)])
def test_sliding(spark, rows, limits):
    out = rate_limit_sliding(calls(spark, rows), "client", "ts", "id", limits, slot_seconds=7200)
    assert {r["key"]: r["reason"] for r in out.collect()} == replay_sliding(rows, limits)


@pytest.mark.parametrize("rows, limits, part", [(RULES[0], Limits(), None), (RULES[1], Limits(), 30), (RULES[2], Limits(), 600), (noise(), SMALL, 7200)])
def test_fixed(spark, rows, limits, part):
    out = rate_limit_fixed(calls(spark, rows), "client", "ts", "id", limits, part)
    assert {r["key"]: r["reason"] for r in out.collect()} == replay_fixed(rows, limits)


def test_fixed_stream_in_two_files(spark):
    rows = sorted(noise(800, 4), key=lambda r: r[1])
    df, folder = calls(spark, rows), fresh_path(spark, "stream-in")
    df.filter("id < 500").coalesce(1).write.mode("append").parquet(folder)
    stream = J.file_stream(spark, folder, df.schema, 1)
    target, log = fresh_path(spark, "verdicts"), fresh_path(spark, "verdicts-log")
    J.run_available(rate_limit_fixed_stream(stream, "client", "ts", "id", SMALL), target, log)
    df.filter("id >= 500").coalesce(1).write.mode("append").parquet(folder)
    out = J.run_available(rate_limit_fixed_stream(stream, "client", "ts", "id", SMALL), target, log)
    assert {r["key"]: r["reason"] for r in out.collect()} == replay_fixed(rows, SMALL)


def test_late_rows_are_dropped(spark):
    folder = fresh_path(spark, "late-in")
    target, log = fresh_path(spark, "late-out"), fresh_path(spark, "late-log")
    kind = "k string, ts timestamp, v double"

    def arrive(*rows):
        at = [(k, pd.Timestamp(t).to_pydatetime(), v) for k, t, v in rows]
        spark.createDataFrame(at, kind).coalesce(1).write.mode("append").parquet(folder)
        stream = J.file_stream(spark, folder, spark.createDataFrame([], kind).schema).withWatermark("ts", J.WATERMARK)
        return J.run_available(J.window_counts(stream, "ts", ["k"], "v"), target, log)

    arrive(("a", "2024-01-01 10:05", 1.0), ("a", "2024-01-01 12:30", 2.0))
    arrive(("a", "2024-01-01 10:06", 100.0), ("a", "2024-01-01 12:25", 4.0))
    out = arrive(("a", "2024-01-01 15:00", 1.0))
    got = {str(r["window_start"]): (r["n"], r["total"]) for r in out.collect()}
    assert got == {"2024-01-01 10:00:00": (1, 1.0), "2024-01-01 12:00:00": (2, 6.0)}


def test_index_sync_adds_only_new_files(spark):
    folder, path, log = fresh_path(spark, "chunks-in"), fresh_path(spark, "index"), fresh_path(spark, "index-log")
    for part in (range(0, 5), range(5, 9)):
        rows = [(i, [float(i), 1.0]) for i in part]
        df = spark.createDataFrame(rows, "id int, v array<double>")
        df.coalesce(1).write.mode("append").parquet(folder)
        J.index_sync(J.file_stream(spark, folder, df.schema), path, log, "id", "v")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(9))


def test_audit_stream_drops_repeats(spark):
    folder, kind = fresh_path(spark, "audit-in"), "request_id int, ts timestamp, path string, status_code int, duration_ms double"
    rows = [(1, pd.Timestamp("2024-01-01").to_pydatetime(), "/a", 500, 1.234), (1, pd.Timestamp("2024-01-01").to_pydatetime(), "/a", 500, 1.234), (2, pd.Timestamp("2024-01-01").to_pydatetime(), "/docs", 200, 1.0)]
    df = spark.createDataFrame(rows, kind)
    df.write.parquet(folder)
    out = J.run_available(J.audit_stream(J.file_stream(spark, folder, df.schema), "ts", "request_id"), fresh_path(spark, "o"), fresh_path(spark, "l"))
    assert [(r["request_id"], r["severity"], r["duration_ms"]) for r in out.collect()] == [(1, "error", 1.23)]
