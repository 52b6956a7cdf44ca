"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search in it.

The graph starts from blocks of vectors that fall on the same side of random planes, compared within the block. Then
neighbours of neighbours meet: every vector gathers those it names and those that name it, compares them with each other and
tells each the best of the others, until few lists change. A query goes from the best known vectors to their neighbours.
The graph works on single-precision copies of length 1, so that no length takes the precision of another; the search multiplies the
length back in. Scores are those of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import written

K = 20
# Neighbours kept in the graph, plane sets to start from, vectors of a block at most on average.
LINKS, PLANE_SETS, BLOCK = 24, 12, 4096
# Names of a vector that meet its neighbours, best others told to each, and the share of changed places that ends the rounds.
NAMED_BY, TOLD, SETTLED = 16, 8, 0.05
# Best vectors a search holds, those it goes on from in one step, steps.
HELD, STEP, STEPS = 96, 48, 3
# The longest vectors, which every query looks at first: where lengths differ, they win inner products far from the query.
ENTRIES = 64
SEED = 11
VECTORS = "id long, code binary, length double"
LISTS = "id long, ids array<bigint>, sims array<float>, changed int"


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vec): vectors of the most frequent length whose components are all finite and not all zero."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0.0)
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(sound)
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vec") == (length[0]["n"] if length else 0))


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def _codes(column: pa.Array) -> np.ndarray:
    """Rows of single-precision numbers."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)


def encoded(vectors: DataFrame) -> DataFrame:
    """(id, code, length): the vector at length 1, and its length."""
    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                most = np.abs(v).max(axis=1, keepdims=True)
                length = np.linalg.norm(v / most, axis=1, keepdims=True)
                code = (v / most / length).astype(np.float32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([r.tobytes() for r in code], pa.binary()), pa.array((most * length).ravel())],
                    names=["id", "code", "length"])

    return vectors.select("id", "vec").mapInArrow(encode, VECTORS)


def _lists(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, old: np.ndarray, k: int, fresh: np.ndarray | None = None) -> pa.RecordBatch:
    """The ``k`` best distinct others of each owner, nearest first; ``changed`` counts those that ``old`` does not mark."""
    order = np.lexsort((~old, other, owner))
    owner, other, sim, old = owner[order], other[order], sim[order], old[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    keep &= owner != other
    owner, other, sim, old = owner[keep], other[keep], sim[keep], old[keep]
    order = np.lexsort((other, -sim, owner))
    owner, other, sim, old = owner[order], other[order], sim[order], old[order]
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(starts, append=len(owner)))
    best = rank < k
    owner, other, sim, old = owner[best], other[best], sim[best], old[best]
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
    ends = np.append(starts, len(owner)).astype(np.int32)
    changed = np.add.reduceat(~old, starts).astype(np.int32) if len(starts) else np.empty(0, np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(owner[starts], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(other, pa.int64())),
        pa.ListArray.from_arrays(ends, pa.array(sim, pa.float32())), pa.array(changed),
    ], names=["id", "ids", "sims", "changed"])


def _flat(batch: pa.RecordBatch, ids: str = "ids", sims: str = "sims") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, similarity) of the lists of a batch."""
    sizes = np.asarray(batch.column(ids).value_lengths().fill_null(0))
    return np.repeat(np.arange(batch.num_rows), sizes), np.asarray(batch.column(ids).flatten()), np.asarray(batch.column(sims).flatten())


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest values of each row."""
    if k >= sims.shape[1]:
        return np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of a partition sorted by ``key`` that never part the rows of one key."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.asarray(table.column(key))
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def start(codes: DataFrame, n: int, links: int, sets: int, block: int, seed: int) -> DataFrame:
    """Lists from blocks: vectors on the same sides of random planes, larger groups dealt into several blocks by id."""
    planes = max(0, int(np.ceil(np.log2(max(1, n) / block))))

    def sides(batches):
        for batch in batches:
            if batch.num_rows:
                x = _codes(batch.column(1))
                normals = np.random.default_rng(seed).normal(size=(x.shape[1], sets, planes)).astype(np.float32)
                side = (np.einsum("nd,dsp->nsp", x, normals) > 0) @ (1 << np.arange(planes, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(list(side.astype(np.int64)), pa.list_(pa.int64()))], names=["id", "code", "side"])

    placed = codes.select("id", "code").mapInArrow(sides, "id long, code binary, side array<bigint>").select("id", "code", F.posexplode("side").alias("nth", "side"))
    sizes = placed.groupBy("nth", "side").agg(F.count("*").alias("n"))
    parts = F.pmod(F.xxhash64("id", "nth"), F.ceil(F.col("n") / block))
    blocks = placed.join(sizes, ["nth", "side"]).withColumn("part", parts).select("id", "code", F.struct("nth", "side", "part").alias("block"))

    def compare(table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table.column("id")), _codes(table.column("code").combine_chunks())
        out = []
        for lo in range(0, len(ids), 512):
            sims = x[lo : lo + 512] @ x.T
            sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -np.inf
            best = _top(sims, links)
            owner = np.repeat(ids[lo : lo + len(sims)], best.shape[1])
            sim = np.take_along_axis(sims, best, 1).ravel()
            some = np.isfinite(sim)
            out.append(_lists(owner[some], ids[best].ravel()[some], sim[some], np.zeros(some.sum(), bool), links))
        return pa.Table.from_batches(out)

    return merge(blocks.groupBy("block").applyInArrow(compare, LISTS), None, links)


def merge(told: DataFrame, graph: DataFrame | None, links: int) -> DataFrame:
    """One list per vector from all lists that name it as owner; those of ``graph`` are its old ones."""
    rows = told.select("id", "ids", "sims", F.lit(False).alias("old"))
    if graph is not None:
        rows = rows.unionByName(graph.select("id", "ids", "sims", F.lit(True).alias("old")))

    def best(batches):
        for table in whole_keys(batches, "id"):
            batch = _one(table)
            row, other, sim = _flat(batch)
            yield _lists(np.asarray(batch.column("id"))[row], other, sim, np.asarray(batch.column("old").to_numpy(False), bool)[row], links)

    parts = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(best, LISTS)


def meet(codes: DataFrame, graph: DataFrame, named_by: int, told: int) -> DataFrame:
    """What neighbours of one vector learn of each other, as lists."""
    ahead = graph.select(F.col("id").alias("hub"), F.explode("ids").alias("id"))
    back = ahead.select(F.col("id").alias("hub"), F.col("hub").alias("id"))
    # A vector that very many name hears only some of them: dealt first, so that no task gathers all.
    dealt = back.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = dealt.groupBy("hub", "part").agg(F.min_by("id", F.xxhash64("id", "hub")).alias("id"))
    few = few.groupBy("hub").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("id", "hub").alias("h"), "id"))), 1, named_by).alias("some"))
    members = ahead.unionByName(few.select("hub", F.explode("some.id").alias("id"))).distinct()
    rows = members.join(codes, "id").select("hub", "id", "code")

    def compare(batches):
        for table in whole_keys(batches, "hub"):
            hubs, ids = np.asarray(table.column("hub")), np.asarray(table.column("id"))
            x = _codes(table.column("code").combine_chunks())
            starts = np.flatnonzero(np.concatenate(([True], hubs[1:] != hubs[:-1])))
            owners, others, values = [], [], []
            for lo, hi in zip(starts, np.append(starts[1:], len(hubs))):
                if hi - lo < 2:
                    continue
                sims = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(sims, -np.inf)
                best = _top(sims, min(told, hi - lo - 1))
                owners.append(np.repeat(ids[lo:hi], best.shape[1]))
                others.append(ids[lo:hi][best].ravel())
                values.append(np.take_along_axis(sims, best, 1).ravel())
            if owners:
                owner = np.concatenate(owners)
                yield _lists(owner, np.concatenate(others), np.concatenate(values), np.zeros(len(owner), bool), 4 * told)

    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "hub").sortWithinPartitions("hub").mapInArrow(compare, LISTS)


def build(vectors: DataFrame, links: int = LINKS, sets: int = PLANE_SETS, block: int = BLOCK,
          settled: float = SETTLED, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(codes, graph) of usable vectors; every vector is a node. Each round is written to the shared folder.

    Rounds end when few places change, or when two in a row do not change fewer than the best round before.
    """
    codes = written(encoded(vectors), "codes")
    n = codes.count()
    graph = written(start(codes, n, links, sets, block, seed), "graph")
    fewest, idle = float("inf"), 0
    while fewest > settled * links * n and idle < 2:
        graph = written(merge(meet(codes, graph, NAMED_BY, TOLD), graph, links), "graph")
        changed = graph.agg(F.sum("changed")).first()[0] or 0
        fewest, idle = min(fewest, changed), 0 if changed < fewest else idle + 1
    return codes, graph


def search(codes: DataFrame, graph: DataFrame, chosen: Column, entries: list[int], held: int = HELD, step: int = STEP, steps: int = STEPS) -> DataFrame:
    """(query, ids) with the ``held`` best found for every vector of the graph that ``chosen``, a condition on ``id``, holds for.

    A query starts at its own node and at the ``entries``. In each step the best ``step`` vectors that it has not gone on from name their neighbours.
    Similarity to a query is the cosine times the length of the other vector, so it orders as the inner product does.
    """
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = codes.filter(chosen).select(F.col("id").alias("query"), F.col("code").alias("asked"))
    none = F.array().cast("array<bigint>")
    state = graph.filter(chosen).select(F.col("id").alias("query"), none.alias("ids"), F.array().cast("array<double>").alias("sims"), none.alias("done"))
    for turn in range(steps + 1):
        ahead = F.slice(F.filter("ids", lambda i: ~F.array_contains("done", i)), 1, step) if turn else F.array("query")
        state = state.withColumn("next", ahead)
        state = written(state.withColumn("done", F.concat("done", "next")), "search")
        names = graph.select(F.col("id").alias("at"), "ids")
        found = state.select("query", F.explode("next").alias("at")).join(names, "at").select("query", F.explode("ids").alias("id"))
        if not turn and entries:
            found = found.unionByName(state.select("query", F.explode(F.array(*map(F.lit, entries))).alias("id")))
        found = found.distinct()
        known = state.select("query", F.explode("ids").alias("id"))
        new = found.filter("id <> query").join(known, ["query", "id"], "left_anti").join(codes, "id").select(
            "query", "id", "code", "length", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<double>").alias("sims"),
            F.lit(None).cast("array<bigint>").alias("done"))
        old = state.join(own, "query").select("query", F.lit(None).cast("bigint").alias("id"), F.col("asked").alias("code"),
                                               F.lit(None).cast("double").alias("length"), "ids", "sims", "done")

        def go(batches):
            for table in whole_keys(batches, "query"):
                queries = np.asarray(table.column("query"))
                heads = np.flatnonzero(~np.asarray(table.column("ids").is_null()))
                bounds = np.append(np.flatnonzero(np.concatenate(([True], queries[1:] != queries[:-1]))), len(queries))
                ids, x = table.column("id").to_numpy(), _codes(table.column("code").combine_chunks())
                lengths = np.asarray(table.column("length").to_numpy(), np.float64)
                out = {"query": [], "ids": [], "sims": [], "done": []}
                for head, lo, hi in zip(heads, bounds, bounds[1:]):
                    row = table.slice(int(head), 1).to_pylist()[0]
                    some = np.arange(lo, hi) != head
                    names = np.concatenate([np.array(row["ids"], np.int64), ids[lo:hi][some].astype(np.int64)])
                    sims = np.concatenate([np.array(row["sims"], np.float64), (x[lo:hi][some] @ x[head]) * lengths[lo:hi][some]])
                    best = np.lexsort((names, -sims))[:held]
                    for name, value in (("query", row["query"]), ("ids", names[best]), ("sims", sims[best]), ("done", row["done"])):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([
                    pa.array(out["query"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int64())),
                    pa.array(out["sims"], pa.list_(pa.float64())), pa.array(out["done"], pa.list_(pa.int64())),
                ], names=["query", "ids", "sims", "done"])

        rows = new.unionByName(old).repartition(parts, "query").sortWithinPartitions("query")
        state = rows.mapInArrow(go, "query long, ids array<bigint>, sims array<double>, done array<bigint>")
    return state.select("query", "ids")


def nearest(vectors: DataFrame, chosen: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, nearest first, equal scores by smaller id.

    ``chosen`` is a condition on ``id`` that picks the queries among the rows; a query is never its own neighbour. ``score`` is
    the inner product of the original vectors in double precision. The graph keeps more links than ``k``, so that even a
    query in a clump of its own finds enough. Vectors that are NULL, zero, of another length than most or
    that hold NULL or non-finite components take no part, nor do rows without an id. Rows that repeat an id and its
    vector count once; of rows that share an id but not the vector, the greatest vector counts. With few vectors all others are found.
    An empty table gives an empty table.
    """
    options = {"links": max(LINKS, k + 4)} | options
    usable_rows = written(usable(vectors, vec_id, vector).groupBy("id").agg(F.max("vec").alias("vec")), "vectors")
    codes, graph = build(usable_rows, **options)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    longest = [r["id"] for r in usable_rows.orderBy(square.desc(), "id").select("id").limit(ENTRIES).collect()]
    found = search(codes, graph, chosen, longest).select(F.col("query").alias("query_id"), F.explode("ids").alias("id"))
    asked = usable_rows.filter(chosen).select(F.col("id").alias("query_id"), F.col("vec").alias("asked"))
    scored = found.join(usable_rows, "id").join(asked, "query_id").select("query_id", F.col("id").alias("vec_id"), F.aggregate(
        F.zip_with("asked", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k)
    lists = scored.groupBy("query_id").agg(best.alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
