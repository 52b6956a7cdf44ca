"""The vector index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import vector_index as I
from brindle.streaming import jobs as J

SCHEMA = "id long, v array<double>, label int"


def rows_of(n, d, seed, clumps=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if clumps:
        x = rng.normal(size=(clumps, d))[rng.integers(0, clumps, n)] + 0.05 * x
    return [(i, [float(f) for f in v], i % 4) for i, v in enumerate(x)]


def brute(rows, asked, k, metric):
    m = np.array([r[1] for r in rows])
    out = {}
    for i, q, _ in asked:
        q = np.array(q)
        s = {"cosine": m @ q / np.linalg.norm(m, axis=1) / np.linalg.norm(q), "dot_product": m @ q, "euclidean": -np.linalg.norm(m - q, axis=1)}[metric]
        order = sorted(range(len(rows)), key=lambda j: (-round(float(s[j]), 9), rows[j][0]))[:k]
        out[i] = [(rows[j][0], pytest.approx(float(s[j]), abs=1e-8)) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot_product", "euclidean"])
def test_all_buckets_give_the_exact_answer(spark, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    monkeypatch.setattr(I, "QUERY_BLOCK", 4)
    rows = rows_of(300, 6, 1)
    table = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "index")
    I.create(table, path, "id", "v", metric=metric, tables=2, bits=2)
    got = found(I.search(table.filter("id % 10 = 0"), path, "id", "v", "id", 7, 4))
    assert got == brute(rows, rows[::10], 7, metric)


@pytest.mark.parametrize("metric, clumps", [("cosine", 0), ("cosine", 40), ("euclidean", 40), ("dot_product", 0)])
def test_recall_of_default_probes(spark, tmp_path, metric, clumps):
    rows = rows_of(4000, 24, 3, clumps)
    table = spark.createDataFrame(rows, SCHEMA).repartition(8)
    path = str(tmp_path / "index")
    spec = I.create(table, path, "id", "v", metric=metric)
    assert spec.bits == 6 and I.read_spec(spark, path) == spec
    got, want = found(I.search(table.filter("id % 40 = 0"), path, "id", "v", "id", 10)), brute(rows, rows[::40], 10, metric)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_a_bucket_with_most_vectors_is_split(spark, tmp_path, monkeypatch):
    """Equal vectors share their bucket in every table; it is compared in parts and nothing is lost."""
    monkeypatch.setattr(I, "BLOCK", 50)
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(600)] + [(1000 + i, v, 1) for i, v, _ in rows_of(60, 3, 4)]
    table = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "index")
    I.create(table, path, "id", "v", tables=2, bits=3)
    got = found(I.search(table.filter("id IN (5, 599)"), path, "id", "v", "id", 5))
    assert {q: [i for i, _ in hits] for q, hits in got.items()} == {5: [0, 1, 2, 3, 4], 599: [0, 1, 2, 3, 4]}


def test_unusable_vectors_and_filters(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, None, 1), (4, [1.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [0.0, 0.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "index")
    I.create(table, path, "id", "v", ["label"], bits=1)
    got = found(I.search(table, path, "id", "v", "id", 3, 2))
    assert got == {1: [(1, 1.0), (2, 0.0), (7, 0.0)], 2: [(2, 1.0), (1, 0.0), (7, 0.0)], 7: [(1, 0.0), (2, 0.0), (7, 0.0)]}
    only = found(I.search(table.filter("id = 1"), path, "id", "v", "id", 3, 2, F.col("label") == 2))
    assert only == {1: [(2, 0.0)]}
    with pytest.raises(ValueError):
        I.create(table, path + "x", "id", "v", metric="hamming")


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    I.create(spark.createDataFrame([], SCHEMA), path, "id", "v")
    assert I.search(spark.createDataFrame([(1, [1.0], 0)], SCHEMA), path, "id", "v", "id").collect() == []


def test_refresh_adds_once_and_a_repeated_batch_replaces_itself(spark, tmp_path):
    rows = rows_of(200, 4, 8)
    table, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index")
    spec = I.create(table.filter("id < 100"), path, "id", "v", ["label"], tables=2, bits=2)
    later = table.filter("id >= 100")
    later.filter("id < 150").write.parquet(str(tmp_path / "in" / "a"))
    stream = J.file_stream(spark, str(tmp_path / "in" / "*"), table.schema)
    I.refresh(stream, path, str(tmp_path / "log"), "id", "v", ["label"])
    later.filter("id >= 150").write.parquet(str(tmp_path / "in" / "b"))
    I.refresh(stream, path, str(tmp_path / "log"), "id", "v", ["label"])
    I._write(later.filter("id >= 150"), spec, path, "id", "v", ["label"], 1)
    assert I.read_part(spark, path, "rows").count() == 200 and I.read_part(spark, path, "buckets").count() == 400
    assert found(I.search(table.filter("id % 50 = 0"), path, "id", "v", "id", 4, 4)) == brute(rows, rows[::50], 4, "cosine")


def test_quality_table(spark, tmp_path):
    rows = rows_of(1500, 12, 5)
    table, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index")
    I.create(table, path, "id", "v", tables=3, bits=5)
    got = {(r.k, r.probes): r for r in I.quality(table, path, "id", "v", (1, 5), (1, 32), 40).collect()}
    assert set(got) == {(1, 1), (1, 32), (5, 1), (5, 32)} and {r.queries for r in got.values()} == {40}
    assert got[5, 32].recall == 1.0 and got[5, 32].distance_ratio == 1.0
    # a query's own vector is in its bucket
    assert got[1, 1].recall == 1.0 and got[5, 1].recall < 1.0 and got[5, 1].distance_ratio > 1.0
    asked = [r["id"] for r in I.sampled(table, "id", 40, 5).collect()]
    have, want = found(I.search(table.filter(F.col("id").isin(asked)), path, "id", "v", "id", 5, 1)), brute(rows, [rows[i] for i in asked], 5, "cosine")
    share = sum(len({i for i, _ in have[q]} & {i for i, _ in want[q]}) for q in asked) / 200
    assert got[5, 1].recall == pytest.approx(share)


def test_a_query_goes_once_to_a_group_of_buckets(spark):
    spec = I.IndexSpec("cosine", 4, 2, 2, 17, 0.0, (0.0,) * 4)
    table = spark.createDataFrame(rows_of(10, 4, 6), SCHEMA)
    # where all buckets are asked for, one table has every vector
    assert [(r.nth, r.group, sorted(r.wanted)) for r in I.probe(table, spec, 4, "id", "v").collect()] == [(0, 0, [0, 1, 2, 3])] * 10
    some = I.probe(table, spec, 3, "id", "v", 2).collect()
    assert len(some) == 40 and {b % 2 == r.group for r in some for b in r.wanted} == {True}


@pytest.mark.parametrize("metric", ["cosine", "dot_product", "euclidean"])
def test_copies_and_long_vectors_in_several_blocks(spark, tmp_path, metric, monkeypatch):
    """Equal vectors beyond what is sorted one by one, and vectors too long for single precision, are found as by all pairs."""
    monkeypatch.setattr(I, "BLOCK", 64)
    monkeypatch.setattr(I, "NEAR_CHUNKS", 8)
    rows = [(i, v, 0) for i, (_, v, _) in enumerate(rows_of(60, 5, 4) + rows_of(1, 5, 6) * 120 + rows_of(60, 5, 8))]
    table = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "index")
    I.create(table, path, "id", "v", metric=metric, tables=2, bits=2)
    assert found(I.search(table.filter("id % 20 = 0"), path, "id", "v", "id", 4, 4)) == brute(rows, rows[::20], 4, metric)
