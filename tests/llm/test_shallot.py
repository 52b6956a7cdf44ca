import hashlib
import math

import numpy as np
import pytest

from brindle.llm import shallot
from brindle.llm.integers import squared

SCHEMA = "vec_id long, embedding array<float>, near int, label int"


def lloyd(rows, k, rounds, size, seed=3):
    """{id: (cluster, distance)} and final centroids by measuring every vector against every centroid in whole numbers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(
        x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    points = [v for _, v in named[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        homes = [best(v)[1] for _, v in kept]
        for c in range(len(points)):
            own = [v for (_, v), h in zip(kept, homes) if h == c]
            if own:
                points[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, best(v)[1], best(v)[0]) for i, v in kept), key=str), points


def clumps(n, d, k, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(k, d))[rng.integers(0, k, n)] + spread * rng.normal(size=(n, d))
    return [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, d, k, spread", [(400, 6, 12, 0.05), (300, 3, 5, 1.0), (200, 2, 1, 0.5), (60, 2, 40, 0.001)])
def test_against_every_distance(frame, n, d, k, spread):
    rows = clumps(n, d, k + 2, n, spread)
    got, points = shallot.cluster(frame([(i, v, 1, 1) for i, v in rows], SCHEMA), clusters=k, rounds=5, size=d)
    want, centres = lloyd(rows, k, 5, d)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and points.tolist() == centres


def test_ties_repeats_and_vectors_that_take_no_part(frame):
    rows = [(i, v) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], [0.5, 0.0], [0.5, 0.0], [0.25, 1.0], [1.0, 0.0], None, [1.0], [float("nan"), 0.0],
                                          [None, 1.0], [float("inf"), 0.0], [-0.0001, -3.0], [-0.0001, -3.0]])]
    rows += [(1, [1.0, 0.0]), (None, [4.0, 4.0]), (None, [4.0, 4.0])]
    got = shallot.report(frame([(i, v, 1, 1) for i, v in rows], SCHEMA), clusters=3, rounds=4, size=2).collect()
    want, centres = lloyd(rows, 3, 4, 2)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    total = sum(w[2] for w in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_fewer_vectors_than_centroids_and_none(frame):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    got = shallot.report(frame([(i, v, 1, 1) for i, v in rows], SCHEMA), clusters=8, rounds=2, size=2).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == [(1, 0, 0), (2, 0, 0)]
    assert shallot.report(frame([], SCHEMA)).collect() == []


def test_component_too_large_for_a_long(frame):
    with pytest.raises(Exception, match="fit a long"):
        shallot.cluster(frame([(1, [1e9, 0.0], 1, 1)], SCHEMA), size=2)


def test_bounds_hold_through_rounds():
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (800, 4))
    points, before = x[:10].copy(), None
    near, other = np.full(len(x), -1), np.zeros(len(x), np.int64)
    upper, lower = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(6):
        near, other, upper, lower = shallot.place(x, near, other, upper, lower, shallot.centroids(points, before))
        d = np.stack([squared(x, p[None]) for p in points], axis=1)
        assert (near == d.argmin(axis=1)).all()
        assert (upper**2 >= d[np.arange(len(x)), near] * (1 - 1e-9)).all()
        d[np.arange(len(x)), near] = np.iinfo(np.int64).max
        assert (np.maximum(lower, 0) ** 2 <= d.min(axis=1) * (1 + 1e-9)).all()
        before = points
        points = np.array([x[near == c].sum(axis=0) // max(1, (near == c).sum()) if (near == c).any() else points[c] for c in range(10)])
