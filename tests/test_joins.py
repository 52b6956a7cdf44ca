"""As-of and range joins against loops over all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import joins as J
from brindle.operators.joins import asof_join, interval_join, join_per_key, range_join

LEFT, RIGHT = "lid int, k string, t int, note string", "rid int, k string, u int, v string"


def pairs_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def random_sides(seed, n=300, keys=("a", "a", "a", "b", "c", None), times=40):
    rnd = random.Random(seed)

    def row(i):
        return i, rnd.choice(keys), rnd.choice([None, *range(times)]), f"x{i}"

    return [row(i) for i in range(n)], [row(i) for i in range(n // 2)]


def brute_asof(lefts, rights, direction, tolerance, allow_equal, null_safe):
    out = []
    for lid, k, t, _ in lefts:
        best = None
        for rid, rk, u, _ in rights:
            if t is None or u is None or k != rk or (k is None and not null_safe) or (u == t and not allow_equal):
                continue
            back, ahead = u <= t, u >= t
            if direction == "backward" and back:
                rank = (t - u, 0, -rid)
            elif direction == "forward" and ahead:
                rank = (u - t, 0, rid)
            elif direction == "nearest":
                rank = (abs(t - u), 0, -rid) if back else (abs(t - u), 1, rid)
            else:
                continue
            if best is None or rank < best[0]:
                best = rank, rid
        if best is not None and tolerance is not None and best[0][0] > tolerance:
            best = None
        out.append((lid, None if best is None else best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance, allow_equal, null_safe", [(None, True, False), (3, True, True), (None, False, False), (0, True, False)])
def test_asof_against_all_pairs(spark, direction, tolerance, allow_equal, null_safe):
    lefts, rights = random_sides(hash(direction) % 97 + (tolerance or 7))
    got = asof_join(spark.createDataFrame(lefts, LEFT), spark.createDataFrame(rights, RIGHT), "t", "u", ["k"], ["rid"], ["rid"], direction,
                    tolerance, allow_equal, "left", null_safe)
    assert pairs_of(got, "lid", "rid") == brute_asof(lefts, rights, direction, tolerance, allow_equal, null_safe)


def test_asof_carries_over_many_ranges(spark):
    """One entity holds all rows; its only right rows come first, so every range but the first lives on what is carried."""
    lefts = [(i, "a", 10 + i, "x") for i in range(2000)]
    rights = [(1, "a", 0, "old"), (2, "a", 5, "new"), (3, "b", 6, "other")]
    got = asof_join(spark.createDataFrame(lefts, LEFT), spark.createDataFrame(rights, RIGHT), "t", "u", ["k"], ["v"])
    assert got.groupBy("v").count().collect() == [("new", 2000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "SinglePartition" not in plan


def test_asof_without_entity_inner_and_times(spark):
    at = datetime(2024, 1, 1)
    lefts = spark.createDataFrame([(1, at), (2, at + timedelta(hours=5)), (3, None)], "lid int, t timestamp_ntz")
    rights = spark.createDataFrame([(7, at + timedelta(hours=1))], "rid int, u timestamp_ntz")
    assert pairs_of(asof_join(lefts, rights, "t", "u", how="inner"), "lid", "rid") == [(2, 7)]
    assert pairs_of(asof_join(lefts, rights, "t", "u", tolerance=timedelta(hours=2)), "lid", "rid") == [(1, None), (2, None), (3, None)]
    assert asof_join(lefts, rights.filter("false"), "t", "u").count() == 3 and asof_join(lefts.filter("false"), rights, "t", "u").count() == 0


def test_asof_refuses_clashing_columns(spark):
    lefts, rights = random_sides(1, 3)
    with pytest.raises(ValueError, match="rename"):
        asof_join(spark.createDataFrame(lefts, LEFT), spark.createDataFrame(rights, RIGHT).withColumnRenamed("v", "note"), "t", "u", ["k"])


POINTS, SPANS = "pid int, pk string, p double", "iid int, ik string, s double, e double"


def random_spans(rnd, n, keys):
    out = []
    for i in range(n):
        s = rnd.choice([None, float("nan")]) if rnd.random() < 0.04 else round(rnd.uniform(0, 100), 1)
        e = None if rnd.random() < 0.03 or s is None else s + rnd.choice([0, 0.1, 1, 5, 80, float("inf"), -1])
        out.append((i, rnd.choice(keys), s, e))
    return out


def holds(closed, p, s, e):
    if None in (p, s, e) or any(x != x for x in (p, s, e)) or s > e:
        return False
    return (p > s or (p == s and closed in ("both", "left"))) and (p < e or (p == e and closed in ("both", "right")))


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
@pytest.mark.parametrize("keyed", [False, True])
def test_range_join_against_all_pairs(spark, closed, keyed):
    rnd = random.Random(len(closed) + keyed)
    keys = ["a", "b", None]
    points = [(i, rnd.choice(keys), rnd.choice([None, float("nan"), round(rnd.uniform(0, 100), 1), 50.0])) for i in range(150)]
    spans = [*random_spans(rnd, 120, keys), (500, "a", float("-inf"), float("inf")), (501, "a", 50.0, 50.0)]
    by = [("pk", "ik")] if keyed else []
    want = [(a, b) for a, pk, p in points for b, ik, s, e in spans if holds(closed, p, s, e) and (not keyed or (pk == ik and pk is not None))]
    sides = spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS)
    assert pairs_of(range_join(*sides, "p", "s", "e", by, closed), "pid", "iid") == sorted(want, key=str)
    alone = [(a, None) for a, _, _ in points if a not in {x for x, _ in want}]
    left = range_join(*sides, "p", "s", "e", by, closed, how="left", key=["pid"])
    assert pairs_of(left, "pid", "iid") == sorted(want + alone, key=str)


@pytest.mark.parametrize("keyed", [False, True])
def test_interval_join_against_all_pairs(spark, keyed):
    rnd = random.Random(9 + keyed)
    lefts, rights = random_spans(rnd, 120, ["a", "b", None]), random_spans(rnd, 140, ["a", "a", "b", None])
    def sound(s, e):
        return s is not None and e is not None and s == s and e == e and s <= e
    want = [(a, b) for a, ak, s, e in lefts for b, bk, u, v in rights
            if sound(s, e) and sound(u, v) and s <= v and u <= e and (not keyed or (ak == bk and ak is not None))]
    other = spark.createDataFrame(rights, "rid int, rk string, u double, v double")
    got = interval_join(spark.createDataFrame(lefts, SPANS), other, "s", "e", "u", "v", [("ik", "rk")] if keyed else [])
    assert pairs_of(got, "iid", "rid") == sorted(want, key=str)


def test_range_join_plan_and_long_interval(spark):
    """No nested loop, and one interval over everything among many short ones is split over the tasks instead of copied per bin."""
    points = spark.range(20_000).select(F.col("id").cast("double").alias("p"))
    spans = spark.range(2_000).select(F.col("id").alias("iid"), (F.col("id") * 10.0).alias("s"), (F.col("id") * 10.0 + 1).alias("e"))
    spans = spans.unionByName(spark.createDataFrame([(-1, -1e300, 1e300)], "iid long, s double, e double"))
    got = range_join(points, spans, "p", "s", "e")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    per = dict(got.groupBy((F.col("iid") < 0).alias("long")).count().collect())
    assert per == {True: 20_000, False: 4_000}


def test_empty_sides(spark):
    points, spans = spark.createDataFrame([(1, "a", 1.0)], POINTS), spark.createDataFrame([(1, "a", 0.0, 2.0)], SPANS)
    for a, b in ((points.filter("false"), spans), (points, spans.filter("false"))):
        assert range_join(a, b, "p", "s", "e").collect() == []
    other = spans.toDF("rid", "rk", "u", "v")
    for a, b in ((spans.filter("false"), other), (spans, other.filter("false"))):
        assert interval_join(a, b, "s", "e", "u", "v").collect() == []


def test_join_per_key_keeps_frequent_rare_and_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else f"k{i}" if i > 500 else "hot") for i in range(2000)], "i int, k string")
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most"))
    assert join_per_key(rows, per, ["k"], "n").agg(F.count("*"), F.sum("most")).collect() == rows.join(
        per.select(F.col("k").alias("j"), "most"), F.expr("k <=> j")).agg(F.count("*"), F.sum("most")).collect()
    assert join_per_key(rows, per.filter("k = 'hot'"), ["k"], "n", "left").count() == 2000


def test_pairs_of_few_bytes_are_dealt_to_many_tasks(spark, monkeypatch):
    """Both sides fit one task by their bytes; their pairs, which grow with the square, must not stay in it."""
    monkeypatch.setattr(J, "PAIRS_PER_TASK", 100, raising=False)
    side = lambda m: spark.range(400).select(F.col("id").alias(f"id_{m}"), F.lit(1).alias(f"k_{m}"), (F.col("id") % 40).cast("double").alias(f"s_{m}"), (F.col("id") % 40 + 0.5).alias(f"e_{m}"))
    pairs = interval_join(side("a"), side("b"), "s_a", "e_a", "s_b", "e_b", [("k_a", "k_b")])
    assert pairs.count() == 40 * 10 * 10
    assert pairs.select(F.spark_partition_id()).distinct().count() > 8
