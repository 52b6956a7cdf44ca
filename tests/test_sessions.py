"""Sessions and late events: tables against a walk over sorted events, streams against tables, and writers stopped half way."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.streaming import jobs as J
from brindle.streaming.late import LATE, MARKS, ON_TIME, LateSplit, committed, late_schema, read_committed
from brindle.streaming.sessions import numbered, session_stream, sessions

START, GAP = datetime(2024, 3, 1), timedelta(minutes=10)
SCHEMA = "user string, ts timestamp, value double"


def events_of(seed, n=600):
    """One user has a third of the events; many events share their time or lie exactly a gap apart."""
    rnd = random.Random(seed)
    users = ["busy"] * 4 + ["a", "b", "c", None] * 2
    return [(rnd.choice(users), START + timedelta(minutes=5 * rnd.randint(0, 600)), float(rnd.randint(1, 9))) for _ in range(n)]


def walk(rows, gap=GAP):
    out, by_user = [], {}
    for user, ts, value in rows:
        by_user.setdefault(user, []).append((ts, value))
    for user, own in by_user.items():
        session = None
        for ts, value in sorted(own):
            if session is None or ts - session[1] > gap:
                session = [ts, ts, 0, 0.0]
                out.append((user, session))
            session[1], session[2], session[3] = ts, session[2] + 1, session[3] + value
    return sorted(((u, *s) for u, s in out), key=str)


def rows_of(df):
    return sorted(((r.user, r.session_start, r.last_event, r.n, r.total) for r in df.collect()), key=str)


def test_batch_against_a_walk(spark):
    rows = events_of(1)
    df = spark.createDataFrame([*rows, ("a", None, 1.0)], SCHEMA)
    assert rows_of(sessions(df, "user", "ts", "value", GAP)) == walk(rows)


def test_one_user_over_many_ranges(spark):
    rows = [("busy", START + timedelta(minutes=i if i < 3000 else i + 60), 1.0) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(sessions(df, "user", "ts", "value", GAP)) == walk(rows)
    per_task = numbered(df, "user", "ts", GAP).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 3000


def test_empty(spark):
    assert sessions(spark.createDataFrame([], SCHEMA), "user", "ts", "value", GAP).collect() == []


@pytest.mark.parametrize("seed", [2, 3])
def test_stream_of_shuffled_batches_equals_batch(spark, tmp_path, seed):
    rows = events_of(seed, 300)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    # the last file moves the watermark beyond all sessions; its own stays open
    files = [shuffled[i::5] for i in range(5)] + [[("end", START + timedelta(days=40), 0.0)]]
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    closed = session_stream(stream, "user", "ts", "value", GAP, "30 days")
    assert rows_of(J.run_available(closed, str(tmp_path / "out"), str(tmp_path / "log"))) == walk(rows)


def arrivals(seed):
    rnd = random.Random(seed)
    return [[(f"u{i}", START + timedelta(minutes=30 * b + rnd.randint(-120, 30)), float(i)) for i in range(20)] for b in range(4)]


def brute_late(batches, delay):
    seen, on_time, late = None, [], []
    for number, batch in enumerate(batches):
        for user, ts, value in batch:
            by = None if seen is None else (seen - delay - ts).total_seconds()
            if by is not None and by > 0:
                late.append((user, ts, number, by))
            else:
                on_time.append((user, ts, number))
        seen = max([t for _, t, _ in batch] + ([seen] if seen else []))
    return sorted(on_time), sorted(late)


DELAY = timedelta(minutes=45)


def tables_of(spark, out):
    schema = spark.createDataFrame([], SCHEMA).schema
    on_time = sorted((r.user, r.ts, r.batch_id) for r in read_committed(spark, out, ON_TIME, schema).collect())
    late = sorted((r.user, r.ts, r.batch_id, r.lateness_seconds) for r in read_committed(spark, out, LATE, late_schema(schema)).collect())
    return on_time, late


def put(spark, folder, batches):
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    batches, out = arrivals(1), str(tmp_path / "out")
    put(spark, str(tmp_path / "in"), batches)
    stream = J.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    LateSplit(out, "ts", DELAY).start(stream, str(tmp_path / "log"))
    want = brute_late(batches, DELAY)
    assert tables_of(spark, out) == want and len(want[1]) > 5
    marks = {r.batch_id: (r.n, r.n_late) for r in committed(spark, out).collect()}
    assert {b: n for b, (n, _) in marks.items()} == dict.fromkeys(range(4), 20) and sum(n for _, n in marks.values()) == len(want[1])


class Stopped(Exception):
    pass


class Breaking(LateSplit):
    """Fails in one batch: before its mark is written, or after it but before the stream knows."""

    def __init__(self, *args, at, marked):
        super().__init__(*args)
        self.at, self.marked = at, marked

    def write(self, batch, number):
        self._tables(batch, number)
        if number == self.at and not self.marked:
            raise Stopped
        self._commit(batch, number)
        if number == self.at:
            raise Stopped


@pytest.mark.parametrize("marked", [False, True])
@pytest.mark.parametrize("at", [0, 2])
def test_writer_stopped_between_write_and_commit(spark, tmp_path, at, marked):
    batches, out, log = arrivals(2), str(tmp_path / "out"), str(tmp_path / "log")
    put(spark, str(tmp_path / "in"), batches)
    stream = J.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    with pytest.raises(Exception, match="Stopped"):
        Breaking(out, "ts", DELAY, at=at, marked=marked).start(stream, log)
    # rows of the broken batch are on disk, but count only when its mark is there
    on_time, late = brute_late(batches[: at + marked], DELAY)
    assert tables_of(spark, out) == (on_time, late)
    LateSplit(out, "ts", DELAY).start(stream, log)
    assert tables_of(spark, out) == brute_late(batches, DELAY)
    # nothing is left to do, and a batch that is written again changes nothing
    LateSplit(out, "ts", DELAY).start(stream, log)
    LateSplit(out, "ts", DELAY).write(spark.createDataFrame(batches[1], SCHEMA), 1)
    assert tables_of(spark, out) == brute_late(batches, DELAY)
    assert committed(spark, out).count() == 4 and MARKS
