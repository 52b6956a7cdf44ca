"""Grouping, set operations, NULL-aware joins, ranks and sketches against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.operators import sets as X
from brindle.operators import sketches as S
from brindle.operators.grouping import cube_sets, grouping_sets, rollup_sets
from brindle.operators.ranking import global_ranks


def bag(df):
    return Counter(tuple(r) for r in df.collect())


ROWS = [("a", 1), ("a", 1), ("a", None), (None, None), (None, None), (None, None), ("b", 2)]
OTHER = [("a", 1), (None, None), ("b", 2), ("b", 2), ("c", 3)]


def test_sets_count_copies(spark, monkeypatch):
    monkeypatch.setattr(X, "COPIES", 2)
    left, right = spark.createDataFrame(ROWS, "k string, n int"), spark.createDataFrame(OTHER, "other string, m long")
    a, b = Counter(ROWS), Counter(OTHER)
    assert bag(X.intersect_all(left, right)) == a & b and bag(X.except_all(left, right)) == a - b
    assert bag(X.except_all(right, left)) == b - a
    assert X.except_all(left, right).columns == ["k", "n"]
    assert bag(X.intersect_all(left, right.filter("false"))) == Counter() and bag(X.except_all(left, right.filter("false"))) == a
    with pytest.raises(ValueError):
        X.except_all(left, right.select("m"))


def test_many_copies_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(X, "COPIES", 100)
    left = spark.range(5000).select(F.lit("same").alias("v"))
    out = X.except_all(left, left.limit(200))
    assert out.count() == 4800
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2400


def brute_anti(lefts, rights, nulls):
    def equal(a, b):
        """SQL's three values: None is unknown."""
        return None if a is None or b is None else a == b

    def row_equal(l, r):
        found = [equal(a, b) for a, b in zip(l, r)]
        return False if False in found else None if None in found else True

    out = []
    for i, *key in lefts:
        verdicts = [row_equal(key, r) for r in rights]
        gone = True in verdicts or (nulls == "not_in" and None in verdicts)
        if not gone:
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("nulls, bloom", [("not_exists", True), ("not_in", False)])
@pytest.mark.parametrize("rights", [[], [(1, "x")], [(1, None), (2, "y")], [(None, "x"), (3, "z")], [(None, None)], [(1, "x"), (2, "y"), (1, None)]])
def test_anti_join_of_two_columns(spark, nulls, bloom, rights):
    lefts = [(10 * i + j, a, b) for i, a in enumerate([1, 2, 3, None]) for j, b in enumerate(["x", "y", None])]
    left, right = spark.createDataFrame(lefts, "id int, a int, b string"), spark.createDataFrame(rights, "c long, d string")
    got = X.anti_join(left, right, [("a", "c"), ("b", "d")], nulls, bloom)
    assert got.columns == left.columns and sorted(r.id for r in got.collect()) == brute_anti(lefts, rights, nulls)


def test_semi_join_and_its_filter(spark):
    rnd = random.Random(2)
    lefts = [(i, rnd.choice([None, *range(5000)])) for i in range(4000)]
    wanted = [None, *range(0, 200, 2)]
    left, right = spark.createDataFrame(lefts, "id int, k int"), spark.createDataFrame([(w,) for w in wanted], "w int")
    got = X.semi_join(left, right, [("k", "w")])
    assert sorted(r.id for r in got.collect()) == [i for i, k in lefts if k is not None and k in wanted]
    assert "bit_get" in got._jdf.queryExecution().executedPlan().toString()
    keys = right.select(F.col("w").alias("k")).filter("k IS NOT NULL")
    passed = left.filter(X.may_match(left, ["k"], X.bloom_words(keys))).count()
    assert passed < 0.02 * len(lefts) + got.count()


def test_too_many_keys_go_without_a_filter(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_BITS", 64)
    left = spark.range(100).toDF("k")
    assert X.bloom_words(left) is None and X.semi_join(left, left.filter("k > 90"), [("k", "k")]).count() == 9
    assert X.anti_join(left, left.filter("k > 90"), [("k", "k")]).count() == 91


GROUPS = [("a", None, 1.0), ("a", "x", 2.0), ("a", "x", None), (None, "x", 4.0), (None, None, 8.0), ("b", "y", None)]


@pytest.mark.parametrize("sets", [rollup_sets(["k", "l"]), cube_sets(["k", "l"]), [("l",)], [()]])
def test_grouping_sets(spark, sets):
    df = spark.createDataFrame(GROUPS, "k string, l string, v double")
    got = grouping_sets(df, ["k", "l"], sets, {"n": ("count", None), "nv": ("count", "v"), "s": ("sum", "v"), "m": ("avg", "v"), "low": ("min", "v"), "high": ("max", "v")})
    want = Counter()
    for s in sets:
        groups = {}
        for k, l, v in GROUPS:
            groups.setdefault((k if "k" in s else "*", l if "l" in s else "*"), []).append(v)
        for (k, l), vs in groups.items():
            known = [v for v in vs if v is not None]
            total, mean = (sum(known), round(sum(known) / len(known), 2)) if known else (None, None)
            want[(None if k == "*" else k, None if l == "*" else l, int(k == "*"), int(l == "*"), (k == "*") + (l == "*"), len(vs), len(known), total, mean,
                  min(known, default=None), max(known, default=None))] += 1
    assert bag(got) == want


def test_grouping_having_and_refusals(spark):
    df = spark.createDataFrame(GROUPS, "k string, l string, v double")
    out = grouping_sets(df, ["k"], rollup_sets(["k"]), {"n": ("count", None)}, F.col("n") >= 3)
    assert bag(out) == Counter([("a", 0, 0, 3), (None, 1, 1, 6)])
    assert grouping_sets(df.filter("false"), ["k"], [()], {"n": ("count", None)}).count() == 0
    with pytest.raises(ValueError):
        grouping_sets(df, ["k"], [("l",)], {"n": ("count", None)})
    with pytest.raises(ValueError):
        grouping_sets(df, ["k"], [()], {"n": ("median", "v")})


def brute_ranks(rows, descending, tiles):
    """{id: (rank, dense, percent, cume)} and the sizes of the tiles."""
    key = lambda v: (v is not None, v if v is not None else 0)
    values = sorted((key(v) for _, v in rows), reverse=descending)
    distinct = sorted(set(values), reverse=descending)
    n, out = len(rows), {}
    for i, v in rows:
        rank = values.index(key(v)) + 1
        out[i] = rank, distinct.index(key(v)) + 1, (rank - 1) / max(1, n - 1), (rank - 1 + values.count(key(v))) / n
    size, more = divmod(n, tiles)
    return out, [size + (t < more) for t in range(tiles)]


@pytest.mark.parametrize("values, descending, tiles", [
    ([7] * 500, False, 3), ([1] * 30 + [2] * 400 + [3] * 20 + [None] * 50, True, 7), (list(range(100)) + [50] * 300, False, 11), ([5], False, 4),
    ([None, None, 1, 2], False, 9),
])
def test_ranks_with_long_ties(spark, values, descending, tiles):
    rows = list(enumerate(values))
    random.Random(1).shuffle(rows)
    got = global_ranks(spark.createDataFrame(rows, "id int, v int"), ["v"], descending, ["id"], tiles).collect()
    want, sizes = brute_ranks(rows, descending, tiles)
    for r in got:
        rank, dense, percent, cume = want[r.id]
        assert (r["rank"], r.dense_rank) == (rank, dense) and r.percent_rank == pytest.approx(percent) and r.cume_dist == pytest.approx(cume)
    ordered = sorted(got, key=lambda r: r.row_number)
    assert [r.row_number for r in ordered] == list(range(1, len(rows) + 1))
    way = (lambda v: (v is not None, v or 0))
    expected = sorted(sorted(rows), key=lambda r: way(r[1]), reverse=descending)
    assert [r.v for r in ordered] == [v for _, v in expected]
    count = Counter(r.ntile for r in got)
    assert [count[t + 1] for t in range(tiles)] == sizes and [r.ntile for r in ordered] == sorted(r.ntile for r in ordered)


def test_ranks_need_no_window_over_everything(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("v"))
    ranked = global_ranks(df, ["v"])
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert global_ranks(df.filter("false"), ["v"]).collect() == []
    two = global_ranks(df.withColumn("w", F.lit(1.0)), ["v", "w"]).groupBy("v").agg(F.min("rank").alias("r"), F.max("cume_dist").alias("c"))
    assert {r.v: (r.r, round(r.c, 6)) for r in two.collect()} == {0: (1, 0.3335), 1: (668, 0.667), 2: (1335, 1.0)}


def test_sketches_merge_and_keep_their_bound(spark, tmp_path):
    """Three months with overlapping users: any span is within the bound, and loading a month in two halves changes nothing."""
    path = str(tmp_path / "sketches")
    users = {"2024-01": range(0, 30_000), "2024-02": range(20_000, 60_000), "2024-03": range(0, 5)}
    for month, some in users.items():
        df = spark.range(some.start, some.stop).select(F.col("id").alias("user"))
        for half in (df.filter("user % 2 = 0"), df.filter("user % 2 = 1 OR user = 0")):
            S.append_sketches(half, path, F.lit(month), ["user"])
    table = S.read_sketches(spark, path)
    for span, exact in ((["2024-01"], 30_000), (["2024-01", "2024-02"], 60_000), (["2024-03"], 5), (["2024-01", "2024-03"], 30_000)):
        r = S.distinct_counts(table.filter(F.col("month").isin(span)), ["user"]).first()
        assert abs(r.user - exact) <= S.DEVIATIONS * S.relative_error() * exact and r.user_low <= exact <= r.user_high
    assert S.distinct_counts(table.filter(F.col("month") == "2024-03"), ["user"]).first().user == 5
    assert table.count() == 6


def test_sketches_ignore_nulls_and_go_by_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 2), (None, 3)], "g string, u int")
    got = S.distinct_counts(S.month_sketches(df, F.lit("m"), ["u"], ["g"]), ["u"], ["g"])
    assert {r.g: (r["rows"], r.u) for r in got.collect()} == {"a": (2, 1), "b": (2, 1), None: (1, 1)}
