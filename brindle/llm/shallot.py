"""Exact k-means on an integer grid by Shallot search.

Every vector carries bounds: an upper one on the distance to its centroid, a lower one on the distance to any other, and which
centroid was second. When the bounds cannot tell that it stays, the two remembered centroids are measured and the search
starts from the closer one. The other centroids follow in the order of their distance from the start, inside a ball whose
radius is the distance to the start plus that to the second best so far: it shrinks with every better centroid found, and
whatever lies outside can be neither nearest nor second. Bounds are rounded outwards; what they leave is compared in integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.integers import SCALE, Rounds, matrix, on_grid, sound, squared

CLUSTERS, ROUNDS, SIZE, SEED = 8, 10, 64, 3
# Outward rounding of bounds, far above the rounding of double arithmetic.
SLACK = 1e-12
STATE = "id long, code binary, near int, other int, upper double, lower double, distance long, sums array<bigint>, moved bigint"


def above(square: np.ndarray) -> np.ndarray:
    """Not less than the root."""
    return np.sqrt(square.astype(np.float64)) * (1 + SLACK)


def below(square: np.ndarray) -> np.ndarray:
    """Not more than the root."""
    return np.sqrt(square.astype(np.float64)) * (1 - SLACK)


@dataclass
class Centroids:
    """Centroids of a round, with what the search needs to know of them."""

    points: np.ndarray
    # Upper bounds on how far each has moved since the round before, and on how far any other has.
    moved: np.ndarray
    others_moved: np.ndarray
    # Lower bounds on the distances between them, the others of each in that order, half the way to the closest other.
    gaps: np.ndarray
    order: np.ndarray
    half: np.ndarray


def centroids(points: np.ndarray, before: np.ndarray | None = None) -> Centroids:
    k = len(points)
    moved = above(squared(points, points if before is None else before))
    ranked = np.sort(moved)[::-1]
    others = np.where((moved == ranked[0]) & (k > 1), ranked[min(1, k - 1)], ranked[0])
    gaps = np.stack([below(squared(points, p[None])) for p in points])
    far = gaps.copy()
    np.fill_diagonal(far, np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, : k - 1]
    return Centroids(points, moved, others, gaps, order, far.min(axis=1) / 2)


def place(x: np.ndarray, near: np.ndarray, other: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids):
    """(near, other, upper, lower) after a round; ``near`` is -1 for vectors without a centroid yet. Equal distances go to the smaller number."""
    k, points = len(c.points), c.points
    fresh = near < 0
    near, other = np.where(fresh, 0, near), np.where(fresh, min(1, k - 1), other)
    if k == 1:
        return near, other, np.zeros(len(x)), np.zeros(len(x))
    upper = np.where(fresh, np.inf, (upper + c.moved[near]) * (1 + SLACK))
    lower = np.where(fresh, 0.0, lower - c.others_moved[near] - SLACK * (np.abs(lower) + c.others_moved[near]))
    bound = np.maximum(lower, c.half[near])
    open_ = np.flatnonzero(~(upper < bound))
    first = squared(x[open_], points[near[open_]])
    upper[open_] = above(first)
    unsure = ~(upper[open_] < bound[open_])
    open_, first = open_[unsure], first[unsure]
    known = other[open_]
    second = squared(x[open_], points[known])
    a, b = near[open_], known.copy()
    swap = (second < first) | ((second == first) & (b < a))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    origin, pair, reach = a.copy(), b.copy(), above(first)
    live = np.arange(len(open_))
    for nth in range(k - 1):
        j = c.order[origin[live], nth]
        inside = c.gaps[origin[live], j] <= reach[live] + above(second[live])
        live, j = live[inside], j[inside]
        if not len(live):
            break
        met = j != pair[live]
        some, j = live[met], j[met]
        d = squared(x[open_[some]], points[j])
        best = (d < first[some]) | ((d == first[some]) & (j < a[some]))
        runner = ~best & ((d < second[some]) | ((d == second[some]) & (j < b[some])))
        up = some[best]
        b[up], second[up] = a[up], first[up]
        a[up], first[up] = j[best], d[best]
        b[some[runner]], second[some[runner]] = j[runner], d[runner]
    near[open_], other[open_], upper[open_], lower[open_] = a, b, above(first), below(second)
    return near, other, upper, lower


def _round(state: DataFrame, c: Centroids, last: bool) -> DataFrame:
    """The next state, and per task one row for each centroid with what vectors that changed sides add to it.

    The last round gives distances in place of such rows.
    """
    k, d = c.points.shape

    def run(batches):
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            was = np.asarray(batch.column(2), np.int64)
            near, other, upper, lower = place(
                x, was, np.asarray(batch.column(3), np.int64), np.asarray(batch.column(4)), np.asarray(batch.column(5)), c)
            n = len(x)
            if last:
                distance = pa.array(squared(x, c.points[near]))
            else:
                distance = pa.nulls(n, pa.int64())
                gone = near != was
                np.add.at(sums, near[gone], x[gone])
                np.add.at(counts, near[gone], 1)
                gone &= was >= 0
                np.subtract.at(sums, was[gone], x[gone])
                np.subtract.at(counts, was[gone], 1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(other.astype(np.int32)), pa.array(upper),
                pa.array(lower), distance, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=names)
        some = np.flatnonzero(counts | sums.any(axis=1))
        if len(some):
            m = len(some)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(some.astype(np.int32)), pa.nulls(m, pa.int32()),
                pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64()),
                pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array(counts[some])], names=names)

    names = [part.split()[0] for part in STATE.split(", ")]
    rows = state.filter("code IS NOT NULL").select("id", "code", "near", "other", "upper", "lower")
    return rows.mapInArrow(run, STATE)


def _changes(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What a round added to each centroid's count and sums; one row per centroid and coordinate comes to the driver."""
    counts, sums = np.zeros(k, object), np.zeros((k, size), object)
    told = state.filter("sums IS NOT NULL").select("near", F.col("moved").cast("decimal(38,0)").alias("moved"), F.posexplode("sums").alias("at", "x"))
    for r in told.groupBy("near", "at").agg(F.sum("moved").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        sums[r["near"], r["at"]] = int(r["x"])
        counts[r["near"]] = int(r["n"])
    return counts, sums


def digest(point) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in point).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED, scale: int = SCALE,
            vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, near, distance) of every vector, final centroids) of Lloyd's rounds on floor(scale * x).

    Vectors that are NULL, of another length than ``size`` or with NULL or non-finite components take no part. Rows without an id, rows that
    repeat an id and equal vectors are clustered like all others. Centroids start as the vectors with the smallest sha256 of ``seed:id``
    (ties by the coordinates' bytes; rows without an id last); with fewer vectors there are fewer centroids, with none an empty table. One that loses
    all its vectors stays where it is. Each round reads the vectors once, writes them with their bounds and lets only sums of
    those that changed sides reach the driver, ``clusters`` times ``size`` numbers. No vector is shuffled, so equal ones make no hot task.
    """
    spark = vectors.sparkSession
    usable = vectors.filter(sound(vector) & (F.size(vector) == size))
    table = Rounds("centroids")
    rows = table.put(on_grid(usable, {"id": F.col(vec_id).cast("bigint")}, vector, scale))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = [np.frombuffer(r["code"], "<i4").astype(np.int64).tolist() for r in rows.orderBy(F.asc_nulls_last(name), "code").limit(clusters).collect()]
    if not first:
        return spark.createDataFrame([], "id long, near int, distance long"), np.zeros((0, size), np.int64)
    points, before = np.array(first, np.int64), None
    counts, sums = np.zeros(len(points), object), np.zeros(points.shape, object)
    state = rows.select("id", "code", *[F.lit(v).cast(t).alias(c) for c, v, t in (
        ("near", -1, "int"), ("other", -1, "int"), ("upper", 0, "double"), ("lower", 0, "double"))])
    for _ in range(rounds):
        state = table.put(_round(state, centroids(points, before), False))
        more, parts = _changes(state, *points.shape)
        counts, sums = counts + more, sums + parts
        before = points
        points = np.array([[s // n for s in row] if n else p for n, row, p in zip(counts, sums, points.tolist())], np.int64)
    final = table.put(_round(state, centroids(points, before), True))
    return final.select("id", "near", "distance"), points


def report(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    placed, points = cluster(vectors, **options)
    # one row per centroid
    own = {r["near"]: int(r["own"]) for r in placed.groupBy("near").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    per = spark.createDataFrame(
        [(c, own.get(c, 0), sum(own.values()), digest(p)) for c, p in enumerate(points)],
        "near int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(per), "near").select(
        F.col("id").alias("vec_id"), F.col("near").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
