import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import neighbours

SMALL = {"sets": 3, "block": 128}
SCHEMA = "vec_id long, embedding array<float>, score int"


def vectors(n, d, seed=0, clusters=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for c in range(clusters):
        some = np.arange(c * 40, c * 40 + 40)
        x[some] = x[some[0]] + 0.01 * x[some]
    return x


def brute(rows, k, queries):
    out = {}
    for q in queries:
        scores = {i: float(np.dot(rows[q].astype(float), v.astype(float))) for i, v in rows.items() if i != q}
        out[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_scores(frame):
    x = vectors(1500, 16)
    x[::7] *= 1.5
    rows = {i: v for i, v in enumerate(x)}
    got = by_query(neighbours.nearest(frame([(i, v.tolist(), 1) for i, v in rows.items()], SCHEMA), F.col("id") % 20 == 0, **SMALL))
    want = brute(rows, 20, range(0, 1500, 20))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda s: (-s[1], s[0]))
        for i, s in found:
            assert s == pytest.approx(float(np.dot(rows[q].astype(float), rows[i].astype(float))), abs=1e-9)
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_few_vectors_ties_and_unusable_ones(frame):
    one = [1.0, 0.0]
    rows = [(0, one, 1), (5, one, 1), (3, one, 1), (3, one, 1), (7, [0.5, 0.5], 1), (8, None, 1), (9, [0.0, 0.0], 1), (10, [1.0, None], 1),
            (11, [float("nan"), 1.0], 1), (12, [float("inf"), 1.0], 1), (20, [1.0], 1), (None, one, 1), (40, [-1.0, 0.0], 1)]
    got = by_query(neighbours.nearest(frame(rows, SCHEMA), F.col("id") % 20 == 0, **SMALL))
    assert got == {0: [(3, 1.0), (5, 1.0), (7, 0.5), (40, -1.0)], 40: [(7, -0.5), (0, -1.0), (3, -1.0), (5, -1.0)]}


def test_empty_table_and_one_vector(frame):
    assert neighbours.nearest(frame([], SCHEMA), F.col("id") % 20 == 0).count() == 0
    assert neighbours.nearest(frame([(0, [1.0], 1)], SCHEMA), F.col("id") % 20 == 0).count() == 0


def test_equal_vectors_are_split_into_blocks(frame):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(400)]
    got = by_query(neighbours.nearest(frame(rows, SCHEMA), F.col("id") % 100 == 0, **SMALL))
    assert all(len(found) == 20 and {s for _, s in found} == {14.0} for found in got.values()) and len(got) == 4


def test_lists_keep_the_best_distinct():
    owner, other = np.array([1, 1, 1, 1, 2]), np.array([5, 5, 6, 1, 7])
    batch = neighbours._lists(owner, other, np.array([0.5, 0.5, 0.9, 1.0, 0.1], np.float32), np.array([False, True, False, False, False]), 2)
    assert [(r["id"], r["ids"], r["changed"]) for r in batch.to_pylist()] == [(1, [6, 5], 1), (2, [7], 1)]


@pytest.mark.parametrize("kind", ["outlier", "lengths"])
def test_recall_where_lengths_differ(frame, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= 1.0 if kind == "outlier" else rng.lognormal(0, 0.4, size=(1500, 1))
    x[7] *= 1e8 if kind == "outlier" else 1.0
    schema = "vec_id long, embedding array<double>"
    # blocks so small that seven planes part them, as 4096 of half a million vectors
    got = by_query(neighbours.nearest(frame([(i, v.tolist()) for i, v in enumerate(x)], schema), F.col("id") % 20 == 0, block=12))
    want = brute(dict(enumerate(x)), 20, range(0, 1500, 20))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want), hits / 20 / len(want)
