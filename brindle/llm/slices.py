"""Vector codes: product codebooks on an integer grid, the nearest entry found by slicing and intersecting.

A codebook keeps, for every dimension, its entries' coordinates in sorted order and for every prefix of that order a bit mask of
the entries in it. A part to code is first measured against its sorted neighbours on the widest dimensions; the best of them
gives the initial radius. Within the radius each dimension admits one slice of its order, whose mask is the difference of two
prefix masks, and the 64-bit words of all dimensions are ANDed. The entries that are left hold every one as near as the
radius, the nearest included; their distances are compared in integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.integers import SCALE, matrix, on_grid, sound, squared
from brindle.operators.joins import join_per_key
from brindle.session import written

ENTRIES, PARTS, ROUNDS = 256, 4, 4
# Dimensions whose sorted neighbours give the radius, and coordinates of candidates measured at once.
PROBED, BLOCK = 4, 1 << 21
SUMS = "part int, entry int, n long, sums array<bigint>"


class Slices:
    """Entries of one codebook, searched exactly."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        m, w = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        words = -(-m // 64)
        bits = np.zeros((m + 1, w, words), np.uint64)
        places = np.arange(w)
        for i in range(m):
            e = self.order[i]
            bits[i + 1] = bits[i]
            bits[i + 1, places, e // 64] |= np.uint64(1) << (e % 64).astype(np.uint64)
        self.prefix = bits
        spread = self.sorted[-1] - self.sorted[0]
        self.probed = np.argsort(-spread, kind="stable")[:PROBED]

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number not below the distance to the nearest entry."""
        least = np.full(len(x), np.iinfo(np.int64).max)
        last = len(self.entries) - 1
        for d in self.probed:
            at = np.searchsorted(self.sorted[:, d], x[:, d])
            for near in (np.maximum(at - 1, 0), np.minimum(at, last)):
                least = np.minimum(least, squared(x, self.entries[self.order[near, d]]))
        return np.ceil(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """(rows, entries): which entries lie within the radius in every dimension."""
        r = self.radius(x)
        left = None
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - r, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + r, "right")
            # a prefix holds every shorter one, so what differs is the slice between them
            inside = self.prefix[high, d] ^ self.prefix[low, d]
            left = inside if left is None else left & inside
        words = left.astype("<u8").view(np.uint8)
        return np.unpackbits(words, axis=1, bitorder="little")[:, : len(self.entries)].astype(bool)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row, equal distances to the smaller entry."""
        m, w = self.entries.shape
        step = max(1, BLOCK // (m * max(w, 1)))
        entry, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for lo in range(0, len(x), step):
            some = x[lo : lo + step]
            row, e = np.nonzero(self.candidates(some))
            d = squared(some[row], self.entries[e])
            starts = np.searchsorted(row, np.arange(len(some)))
            best = np.minimum.reduceat(d, starts)
            entry[lo : lo + step] = np.minimum.reduceat(np.where(d == best[row], e, m), starts)
            least[lo : lo + step] = best
        return entry, least


def usable(vectors: DataFrame, parts: int, vector: str) -> DataFrame:
    """Vectors without NULL or non-finite components, of the most frequent length that can be cut into the parts."""
    rows = vectors.filter(sound(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    length = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size(vector) == (length[0]["n"] if length else 0))


def _told(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Per task and entry in use: how many parts chose it, and the sums of their coordinates."""
    def run(batches):
        search = [Slices(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            if batch.num_rows:
                for p, x in enumerate(np.hsplit(matrix(batch.column(0)), len(books))):
                    entry, _ = search[p].nearest(x)
                    np.add.at(sums[p], entry, x)
                    np.add.at(counts[p], entry, 1)
        for p in range(len(books)):
            e = np.flatnonzero(counts[p])
            if len(e):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(e), p, np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p][e]),
                    pa.array(list(sums[p][e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return rows.select("code").mapInArrow(run, SUMS)


def fit(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of (id, code) rows, one array of entries per part.

    They start from the vectors with the ``entries`` smallest ids, rows without an id last, equal ids by the coordinates' bytes; with
    fewer vectors there are fewer entries. Every round reads the codes once; what comes to the driver is as large as the codebooks.
    """
    first = rows.select("id", "code").orderBy(F.asc_nulls_last("id"), "code").limit(entries).collect()
    if not first:
        return []
    books = np.hsplit(np.stack([np.frombuffer(r["code"], "<i4").astype(np.int64) for r in first]), parts)
    for _ in range(rounds):
        books = [b.copy() for b in books]
        parted = _told(rows, books).select("part", "entry", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("sums").alias("at", "x"))
        per = parted.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in per.collect():
            books[r["part"]][r["entry"], r["at"]] = int(r["x"]) // int(r["n"])
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The rows without ``code``'s coordinates: ``code`` as hexadecimal entry numbers in part order, and ``error``, the squared distance to them."""
    kept = [f for f in rows.schema.fields if f.name != "code"]
    digits = max(2, len(f"{len(books[0]) - 1:x}")) if books else 2
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["code string", "error long"])

    def run(batches):
        search = [Slices(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            names, error = [], np.zeros(batch.num_rows, np.int64)
            for book, x in zip(search, np.hsplit(matrix(batch.column(batch.num_columns - 1)), len(books))):
                entry, least = book.nearest(x)
                names.append(entry)
                error += least
            code = ["".join(f"{e:0{digits}x}" for e in row) for row in np.stack(names, axis=1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(code), pa.array(error)], names=[*batch.schema.names[:-1], "code", "error"])

    return rows.select(*[f.name for f in kept], "code").mapInArrow(run, schema)


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """Adds ``vector``, the entries that a code names put together and scaled back."""
    digits = max(2, len(f"{len(books[0]) - 1:x}"))

    @F.pandas_udf("array<double>")
    def back(code: pd.Series) -> pd.Series:
        return code.map(lambda c: [v / scale for p, b in enumerate(books) for v in b[int(c[p * digits : (p + 1) * digits], 16)].tolist()])

    return codes.withColumn("vector", back("code"))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE,
             vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error) of every vector that takes part, codebooks).

    Vectors that are NULL or hold NULL or non-finite components take no part, nor do those of another length than most, which could not be cut
    like the others. Repeated rows, repeated ids and rows without an id are coded like all others. An empty table gives an empty one.
    """
    columns = {"id": F.col(vec_id).cast("bigint"), "label": F.col(label)}
    rows = written(on_grid(usable(vectors, parts, vector), columns, vector, scale), "grid")
    books = fit(rows, entries, parts, rounds)
    return written(encode(rows, books), "codes"), books


def report(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); ``label_error`` is the error of all vectors with an equal label, NULLs together."""
    codes, books = compress(vectors, **options)
    per = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"), F.count("*").alias("n"))
    return join_per_key(codes, per, ["label"], "n").select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
