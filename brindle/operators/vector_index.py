"""Approximate vector search in a persisted index of random-projection buckets.

A vector falls into one bucket per table: a projection on each of the table's random directions is compared with the direction's
median, one bit each. A search looks into the bucket of the query and into those that are cheapest to reach from it, by how far the
query lies from the planes crossed. Buckets that agree in their lowest bits travel together as a group, so a query is sent once to a group
of which it asks for several buckets and leaves it with its best hits. Buckets are compared as matrices, large groups in parts and many
queries in blocks, so a task's memory is bounded whatever the data; what comes out is ranked again by the original vectors in double precision.

Folder of an index: ``spec`` (one row: metric, directions' seed and medians), ``rows`` and ``buckets`` with one folder per batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.vectors import METRICS
from brindle.operators.joins import join_per_key, partitions
from brindle.operators.search import LONGEST, NEAR_CHUNKS, SCORE_DIGITS, vector_search
from brindle.session import written

TABLES, PROBES = 12, 24
# Vectors of a bucket that the number of bits aims at, and the greatest number of bits.
PER_BUCKET, MOST_BITS = 64, 24
# Rows that the medians are taken from; all rows are indexed whatever the medians.
SAMPLE = 20_000
# Vectors of a group of buckets that the number of groups aims at; vectors and queries of a group that one call takes at most.
GROUP, PART, QUERY_PART = 32_768, 32_768, 32_768
# Vectors and queries that one task compares at a time, planes that may be crossed, hits of a bucket kept beside the k best.
BLOCK, QUERY_BLOCK, CROSSED, SPARE = 4096, 1024, 10, 8
# Single-precision products that agree in so many digits count as equal until the originals are compared.
NEAR_DIGITS = 6
SPEC = "metric string, dimensions int, tables int, bits int, seed long, longest double, medians array<double>"


@dataclass(frozen=True)
class IndexSpec:
    """What has to be the same for every batch and every search of an index."""

    metric: str
    dimensions: int
    tables: int
    bits: int
    seed: int
    longest: float
    medians: tuple[float, ...]

    def directions(self) -> np.ndarray:
        size = self.dimensions + (self.metric == "dot_product")
        return np.random.default_rng(self.seed).normal(size=(size, self.tables * self.bits)).astype(np.float32)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Vectors as points whose closeness orders as the metric does.

        For dot products a component is added that brings all to the same length; one longer than the longest at creation gets none.
        """
        if self.metric == "cosine":
            return _unit(x)
        if self.metric == "dot_product":
            x = x / self.longest if self.longest else x
            rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("nd,nd->n", x, x)))
            return np.hstack([x, rest[:, None]]).astype(np.float32)
        return x.astype(np.float32)

    def queries(self, x: np.ndarray) -> np.ndarray:
        if self.metric == "dot_product":
            return np.hstack([_unit(x), np.zeros((len(x), 1), np.float32)])
        return self.rows(x)

    def sides(self, points: np.ndarray) -> np.ndarray:
        """Signed distances from the planes: points x tables x bits."""
        return (points @ self.directions() - np.asarray(self.medians, np.float32)).reshape(len(points), self.tables, self.bits)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0).astype(np.float32)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vector: str, dimensions: int | None = None) -> DataFrame:
    """Vectors without NULL or non-finite components; of ``dimensions`` components if given."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    right = F.size(vector) == dimensions if dimensions else F.size(vector) > 0
    return vectors.filter(F.col(vector).isNotNull() & right).filter(sound)


def fit_spec(
    vectors: DataFrame, key: str, vector: str, metric: str = "cosine", tables: int = TABLES, bits: int | None = None, seed: int = 17,
    sample: int = SAMPLE, per_bucket: int = PER_BUCKET,
) -> IndexSpec:
    """Size, medians and longest vector for an index of ``vectors``.

    Size is that of most vectors. Medians come from the ``sample`` rows whose hashed key is smallest: they make buckets even, no row
    is left out for them.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {sorted(METRICS)}")
    rows = usable(vectors, vector)
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dimensions, n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (1, 0)
    rows = rows.filter(F.size(vector) == dimensions)
    bits = min(MOST_BITS, max(0, round(np.log2(max(1, n) / per_bucket)))) if bits is None else bits
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = float(np.sqrt(rows.agg(F.max(square)).first()[0] or 0.0)) if metric == "dot_product" else 0.0
    spec = IndexSpec(metric, dimensions, tables, bits, seed, longest, (0.0,) * (tables * bits))
    some = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    if some.num_rows and bits:
        points = spec.rows(_vectors(some.column(0).combine_chunks()))
        spec = IndexSpec(**(asdict(spec) | {"medians": tuple(float(m) for m in np.median(points @ spec.directions(), axis=0))}))
    return spec


def _write(rows: DataFrame, spec: IndexSpec, path: str, key: str, vector: str, keep: Sequence[str], batch: int) -> None:
    """One batch of the index. A batch that is written again replaces what it wrote before."""
    fit = usable(rows, vector, spec.dimensions).select(key, *keep, F.col(vector).cast("array<double>").alias("vector"))
    fit.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    fit = rows.sparkSession.read.schema(fit.schema).parquet(f"{path}/rows/batch={batch}")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fit.schema.fields[:-1]] + ["code binary, places array<bigint>"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            if some.num_rows:
                points = spec.rows(_vectors(some.column(some.num_columns - 1)))
                places = (spec.sides(points) > 0) @ (1 << np.arange(spec.bits, dtype=np.int64))
                arrays = [*some.columns[:-1], pa.array([p.tobytes() for p in points], pa.binary()), pa.array(list(places.astype(np.int64)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*some.schema.names[:-1], "code", "places"])

    placed = fit.mapInArrow(place, schema).select(key, *keep, "code", F.posexplode("places").alias("nth", "bucket"))
    # sorted, so that a search reads the row groups of the buckets it asks for
    placed.sortWithinPartitions("nth", "bucket").write.mode("overwrite").parquet(f"{path}/buckets/batch={batch}")


def create(
    vectors: DataFrame, path: str, key: str, vector: str, keep: Sequence[str] = (), metric: str = "cosine", **options,
) -> IndexSpec:
    """Build the index of ``vectors`` in a new folder. ``keep`` are columns that searches may filter on.

    Vectors that are NULL, of another size than most, or hold NULL or non-finite components are not indexed. ``options`` go to ``fit_spec``.
    """
    spec = fit_spec(vectors, key, vector, metric, **options)
    row = vectors.sparkSession.createDataFrame([tuple(asdict(spec).values())], SPEC)
    row.coalesce(1).write.parquet(f"{path}/spec")
    _write(vectors, spec, path, key, vector, keep, -1)
    return spec


def read_spec(spark: SparkSession, path: str) -> IndexSpec:
    row = spark.read.schema(SPEC).parquet(f"{path}/spec").first().asDict()
    return IndexSpec(**(row | {"medians": tuple(row["medians"])}))


def refresh(vectors: DataFrame, path: str, checkpoint: str, key: str, vector: str, keep: Sequence[str] = (), interval: str | None = None):
    """Index newly arrived vectors of a stream, a folder per micro-batch.

    Without ``interval`` the waiting files are indexed and the call returns (a triggered sync); with it the stream goes on (a continuous one).
    """
    spec = read_spec(vectors.sparkSession, path)
    writer = vectors.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: _write(batch, spec, path, key, vector, keep, number))
    if interval:
        return writer.trigger(processingTime=interval).start()
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """``rows`` or ``buckets`` of all batches."""
    return spark.read.parquet(f"{path}/{part}").drop("batch")


def _probes(spec: IndexSpec, count: int):
    """Buckets of each query: its own, then those that cross the nearest planes."""
    crossed = min(spec.bits, CROSSED)
    subsets = (np.arange(1 << crossed)[:, None] >> np.arange(crossed)) & 1

    def of(sides: np.ndarray) -> np.ndarray:
        """(queries, tables, buckets)"""
        own = (sides > 0) @ (1 << np.arange(spec.bits, dtype=np.int64))
        near = np.argsort(np.abs(sides), axis=2)[:, :, :crossed]
        cost = np.take_along_axis(sides, near, axis=2).astype(np.float64) ** 2 @ subsets.T
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :count]
        flips = np.einsum("qtpc,qtc->qtp", subsets[best], 1 << near.astype(np.int64))
        return own[:, :, None] ^ flips

    return of


def probe(queries: DataFrame, spec: IndexSpec, count: int, query_key: str, query_vector: str, groups: int = 1) -> DataFrame:
    """(query_id, query, nth, group, wanted): the ``count`` cheapest buckets per table of each query, all of them if there are no more.

    One row per group of buckets, ``groups`` of them per table by the lowest bits; ``wanted`` are the buckets of the group. Where all buckets
    are asked for, one table has every vector. Beyond ``CROSSED`` planes only the nearest are crossed, so ``count`` reaches at most 2 to that power.
    """
    kind = queries.schema[query_key].dataType.simpleString()
    rows = usable(queries, query_vector, spec.dimensions).select(F.col(query_key).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v"))
    of = _probes(spec, count)
    tables = 1 if spec.bits <= CROSSED and count >= 1 << spec.bits else spec.tables

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                points = spec.queries(_vectors(some.column(1)))
                buckets = of(spec.sides(points)[:, :tables]) if spec.bits else np.zeros((len(points), tables, 1), np.int64)
                lists = [[{"nth": t, "group": g, "wanted": row[row % groups == g].tolist()} for t, row in enumerate(q) for g in np.unique(row % groups).tolist()]
                         for q in buckets]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([p.tobytes() for p in points], pa.binary()), pa.array(lists, at)], names=["query_id", "query", "at"])

    at = pa.list_(pa.struct([("nth", pa.int32()), ("group", pa.int64()), ("wanted", pa.list_(pa.int64()))]))
    found = rows.mapInArrow(ask, f"query_id {kind}, query binary, at array<struct<nth:int,group:bigint,wanted:array<bigint>>>")
    return found.select("query_id", "query", F.inline("at"))


def search(
    queries: DataFrame, path: str, query_key: str, query_vector: str, key: str, k: int = 5, probes: int = PROBES, where: Column | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): of the vectors in the probed buckets the ``k`` best of each query, equal scores by chunk.

    ``where`` holds for columns that the index keeps. Scores are those of ``vector_search``: cosine, dot product or negative distance in
    double precision. Queries that are NULL, of another size or hold NULL or non-finite components find nothing.
    """
    spark = queries.sparkSession
    spec = read_spec(spark, path)
    buckets = read_part(spark, path, "buckets")
    buckets = (buckets.filter(where) if where is not None else buckets).select(F.col(key).alias("chunk_id"), "code", "nth", "bucket")
    groups = 1 << max(0, min(spec.bits, (buckets.filter("nth = 0").count() // GROUP).bit_length()))
    asked = written(probe(queries, spec, probes, query_key, query_vector, groups), "probes")
    buckets = buckets.withColumn("group", F.col("bucket") % groups)
    sizes = buckets.groupBy("nth", "group").agg(F.count("*").alias("n"))
    wanted = asked.groupBy("nth", "group").agg(F.count("*").alias("nq"))
    cells = written(sizes.join(wanted, ["nth", "group"]), "sizes")
    # few groups are cut finer, so that all tasks have some
    finer = max(1, math.ceil(math.sqrt(partitions(buckets) / max(1, cells.count()))))

    def cut(n: str, most: int, least: int) -> Column:
        return F.greatest(F.ceil(F.col(n) / most), F.least(F.lit(finer), F.ceil(F.col(n) / least))).cast("int")

    cells = written(cells.select("nth", "group", F.col("n").alias("rows"), cut("n", PART, BLOCK).alias("parts"), cut("nq", QUERY_PART, QUERY_BLOCK).alias("blocks"), "nq"), "cells")
    # a large group meets its queries in parts, many queries meet it in blocks
    left = join_per_key(buckets, cells.drop("nq"), ["nth", "group"], "rows").select(
        "nth", "group", F.pmod(F.xxhash64("chunk_id", "nth"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk_id", "code", "bucket")
    right = join_per_key(asked, cells.drop("rows"), ["nth", "group"], "nq").select(
        "nth", "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("query_id", "nth"), "blocks").cast("int").alias("block"), "query_id", "query", "wanted")
    kept = k + SPARE
    kinds = [queries.schema[query_key].dataType.simpleString(), buckets.schema["chunk_id"].dataType.simpleString()]
    euclidean = spec.metric == "euclidean"

    def compare(rows: pa.Table, asking: pa.Table) -> pa.Table:
        if not rows.num_rows or not asking.num_rows:
            return pa.table({"query_id": asking.column("query_id").slice(0, 0), "chunk_id": rows.column("chunk_id").slice(0, 0), "near": pa.array([], pa.float64())})
        # copies of a row once, by chunk, so that of equal ones the first come first
        rows = rows.group_by(["chunk_id", "bucket", "code"], use_threads=False).aggregate([]).sort_by("chunk_id")
        x, q, bucket = _codes(rows.column("code")), _codes(asking.column("query")), rows.column("bucket").to_numpy()
        best = np.full((len(q), kept), -np.inf), np.full((len(q), kept), len(x), np.int32)
        # products that fit single precision
        sound = max(float(np.abs(x).max()), float(np.abs(q).max())) < LONGEST
        lists = asking.column("wanted").combine_chunks()
        asks = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        asked_for = lists.flatten().to_numpy()
        by_bucket, by_asked = np.argsort(bucket, kind="stable"), np.argsort(asked_for, kind="stable")
        bucket, asked_for = bucket[by_bucket], asked_for[by_asked]
        for b in np.intersect1d(bucket, asked_for).tolist():
            members = by_bucket[slice(*np.searchsorted(bucket, [b, b + 1]))]
            askers = asks[by_asked[slice(*np.searchsorted(asked_for, [b, b + 1]))]]
            for lo in range(0, len(members), BLOCK):
                some = members[lo:lo + BLOCK]
                for at in range(0, len(askers), QUERY_BLOCK):
                    who = askers[at:at + QUERY_BLOCK]
                    if sound:
                        reach(best, who, q[who], x[some], some)
                    else:
                        take(best, who, q[who], x[some], some)
        hit = best[1] < len(x)
        return pa.table({"query_id": asking.column("query_id").take(np.nonzero(hit)[0]), "chunk_id": rows.column("chunk_id").take(best[1][hit]),
                         "near": pa.array(best[0][hit])})

    def take(best: tuple[np.ndarray, np.ndarray], who: np.ndarray, q: np.ndarray, x: np.ndarray, some: np.ndarray) -> None:
        """Merges the best of ``x``, the rows ``some``, into those of the queries ``who``."""
        near, which = nearest(q, x)
        near, which = np.hstack([best[0][who], near]), np.hstack([best[1][who], some[which].astype(np.int32)])
        order = np.lexsort((which, -near), axis=1)[:, :kept]
        best[0][who], best[1][who] = np.take_along_axis(near, order, axis=1), np.take_along_axis(which, order, axis=1)

    def reach(best: tuple[np.ndarray, np.ndarray], who: np.ndarray, q: np.ndarray, x: np.ndarray, some: np.ndarray) -> None:
        """As ``take``, but only rows that reach a query's last hit so far, or are among the best of ``x`` for a query with too few, are sorted."""
        products = q @ x.T
        near = products
        if euclidean:
            squares = np.einsum("nd,nd->n", x, x)
            near = 2 * products - squares
        # rounding to NEAR_DIGITS and that of the difference above
        slack = 2 * 10.0 ** -NEAR_DIGITS + 2.0 ** -21 * max(float(np.abs(near).max()), float(squares.max()) if euclidean else 0.0)
        least = best[0][who, -1] - slack
        short = np.flatnonzero(np.isneginf(least))
        if len(short) and len(some) > kept:
            least[short] = np.partition(near[short], len(some) - kept, axis=1)[:, len(some) - kept] - slack
        bound = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        asking = np.flatnonzero(near.max(axis=1) >= bound)
        row, at = np.divmod(np.flatnonzero(near[asking] >= bound[asking, None]), len(some))
        row = asking[row]
        crowded = np.bincount(row, minlength=len(who)) > max(NEAR_CHUNKS, kept)
        if crowded.any():
            take(best, who[crowded], q[crowded], x, some)
            row, at = row[~crowded[row]], at[~crowded[row]]
        if not len(row):
            return
        value = products[row, at].astype(np.float64)
        value = np.round(2 * value - squares[at] if euclidean else value, NEAR_DIGITS)
        own = np.unique(row)
        row = np.concatenate((np.repeat(own, kept), row))
        value = np.concatenate((best[0][who[own]].ravel(), value))
        which = np.concatenate((best[1][who[own]].ravel(), some[at].astype(np.int32)))
        order = np.lexsort((which, -value, row))
        starts = np.searchsorted(row[order], own)
        first = order[starts[:, None] + np.arange(kept)]
        best[0][who[own]], best[1][who[own]] = value[first], which[first]

    def nearest(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Closeness and place of the best of ``x`` for each query, equal ones by place."""
        near = (q @ x.T).astype(np.float64)
        if euclidean:
            near = 2 * near - np.einsum("nd,nd->n", x, x)
        near = np.round(near, NEAR_DIGITS)
        m = min(kept, len(x))
        best = np.argpartition(-near, m - 1, axis=1)[:, :m]
        edge = np.take_along_axis(near, best, axis=1).min(axis=1)
        for row in np.flatnonzero((near >= edge[:, None]).sum(axis=1) > m):
            best[row] = np.argsort(-near[row], kind="stable")[:m]
        near = np.take_along_axis(near, best, axis=1)
        return np.where(np.isnan(near), -np.inf, near), best

    cell = ["nth", "group", "part", "block"]
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compare, f"query_id {kinds[0]}, chunk_id {kinds[1]}, near double")
    # at most tables x groups asked x parts x kept rows per query
    once = met.groupBy("query_id", "chunk_id").agg(F.max("near").alias("near"))
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id")
    top = once.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= kept).drop("_n", "near")
    rows = read_part(spark, path, "rows").select(F.col(key).alias("chunk_id"), "vector")
    own = queries.select(F.col(query_key).alias("query_id"), F.col(query_vector).alias("_q"))
    score = METRICS[spec.metric](F.col("_q"), F.col("vector"))
    scored = top.join(rows, "chunk_id").join(own, "query_id").select("query_id", "chunk_id", F.round(-score if euclidean else score, SCORE_DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)


def sampled(vectors: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest md5 of seed and key."""
    return vectors.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def quality(
    vectors: DataFrame, path: str, key: str, vector: str, ks: Sequence[int] = (5, 10), probes: Sequence[int] = (4, 16, 64), queries: int = 200, seed: int = 5,
) -> DataFrame:
    """(k, probes, queries, recall, distance_ratio) of the index against exact search, over a seeded sample of the vectors as queries.

    ``recall`` is the share of the exact ``k`` nearest that is found; ``distance_ratio`` compares the distances of those found with the exact ones rank by rank
    and is 1 when as good (1 - cosine, distance, or the exact dot product over the found one); ranks not found are left to ``recall``.
    """
    spec = read_spec(vectors.sparkSession, path)
    asked = written(sampled(usable(vectors, vector, spec.dimensions), key, queries, seed).select(F.col(key).alias("_query"), F.col(vector).alias("_vector")), "sample")
    rows = usable(vectors, vector, spec.dimensions)
    exact = written(vector_search(asked, rows, "_query", "_vector", key, vector, max(ks), spec.metric), "exact")
    out = None
    for count in probes:
        found = written(search(asked, path, "_query", "_vector", key, max(ks), count), "found")
        for k in ks:
            want, have = exact.filter(F.col("rank") <= k), found.filter(F.col("rank") <= k)
            hit = want.select("query_id", "chunk_id").join(have.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
            share = hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.countDistinct("query_id").alias("queries"))
            pairs = want.select("query_id", "rank", F.col("score").alias("best")).join(have.select("query_id", "rank", "score"), ["query_id", "rank"])
            far, least = {"cosine": (1 - F.col("score"), 1 - F.col("best")), "euclidean": (-F.col("score"), -F.col("best")),
                          "dot_product": (F.col("best"), F.col("score"))}[spec.metric]
            ratio = pairs.agg(F.coalesce(F.try_divide(F.sum(far), F.sum(least)), F.lit(1.0)).alias("distance_ratio"))
            row = share.select(F.lit(k).alias("k"), F.lit(count).alias("probes"), "queries", F.round("recall", 6).alias("recall"),
                               F.lit(round(ratio.first()[0], 6)).alias("distance_ratio"))
            out = row if out is None else out.unionByName(row)
    return out
