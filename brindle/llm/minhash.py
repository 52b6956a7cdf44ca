"""Near duplicates by MinHash with tensored banding.

A text has two collections of ``side`` small keys, each made of ``rows`` minima. A table is a pair of small keys, one from
each collection, so ``side`` squared tables of ``2 * rows`` minima cost ``2 * side * rows`` minima. Texts
that share a table are candidates; a link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.graph import components
from brindle.llm.memory import give_back
from brindle.llm.shingles import mixed, shingle_sets, shingle_slices
from brindle.session import written

SHINGLE, PERCENT = 5, 80
# With these, two sets of similarity 0.8 miss each other with a chance of 4 in 10,000, of 0.85 with 2 in 100,000.
SIDE, ROWS = 12, 3
SEED = 7
# Buckets by which shingles are ordered: a table of fixed size. Any order gives the same pairs.
BUCKETS = 1 << 16
SIGNATURE = "doc_id bigint, n_shingles bigint, set_key binary, keys array<bigint>"


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(0, 1 << 63, n, np.uint64), random.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)


def _small_keys(hashes: np.ndarray, at: np.ndarray, side: int, rows: int) -> np.ndarray:
    """Small keys of the sets that start at ``at``, one row per set; the first ``side`` make one collection."""
    shift, factor = _permutations(2 * side * rows)
    out = np.empty((len(at), 2 * side), np.uint64)
    for i in range(2 * side):
        key = np.full(len(at), i + 1, np.uint64)
        for j in range(i * rows, (i + 1) * rows):
            key = mixed(key + np.minimum.reduceat((hashes ^ shift[j]) * factor[j], at))
        out[:, i] = key
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys) of every row; ``set_key`` and ``keys`` are NULL for a text without words."""

    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, hashes, bounds in shingle_slices(texts, shingle):
                some = np.flatnonzero(np.diff(bounds))
                sets = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
                keys = [None] * (hi - lo)
                if len(some):
                    for i, row in zip(some, _small_keys(hashes, bounds[some], side, rows).view(np.int64)):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "set_key", "keys"])
        give_back()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sign, SIGNATURE)


def tables(classes: DataFrame) -> DataFrame:
    """(table, class_id, n) for all tables that hold at least two classes by both of their small keys.

    A small key that no other class has can make no pair, so it is left out before pairs of keys are formed.
    """
    small = classes.select("class_id", F.posexplode("keys").alias("place", "key"))
    shared = small.groupBy("place", "key").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    alive = small.join(shared, ["place", "key"], "left_semi").groupBy("class_id").agg(F.collect_list(F.struct("place", "key")).alias("alive"))
    alive = alive.join(classes.select("class_id", "n", F.expr("cast(size(keys) div 2 as int)").alias("side")), "class_id")
    first = F.filter("alive", lambda k: k["place"] < F.col("side"))
    second = F.filter("alive", lambda k: k["place"] >= F.col("side"))
    pairs = alive.withColumns({"first": first, "second": second}).select("class_id", "n", F.explode("first").alias("x"), "second")
    return pairs.select("class_id", "n", "x", F.explode("second").alias("y")).select(F.xxhash64("x", "y").alias("table"), "class_id", "n")


def _fits(n: str, m: str, percent: int):
    """Sets of such sizes can be as similar as asked."""
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))


def pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of the smallest and of the greatest class of every table with each other class of it."""
    ends = rows.groupBy("table").agg(
        F.min(F.struct("class_id", "n")).alias("low"), F.max(F.struct("class_id", "n")).alias("high"))
    ends = ends.filter("low.class_id < high.class_id")
    met = rows.join(ends, "table").select("class_id", "n", F.explode(F.array("low", "high")).alias("end"))
    return met.filter((F.col("end.class_id") != F.col("class_id")) & _fits("n", "end.n", percent)).select(
        F.least("class_id", "end.class_id").alias("a"), F.greatest("class_id", "end.class_id").alias("b")).distinct()


def open_classes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(class_id, of) of the classes that share a table with a class of another component, with their own component."""
    now = rows.join(found, rows["class_id"] == found["node"], "left").select(
        "table", "class_id", F.coalesce("component", "class_id").alias("of"))
    split = now.groupBy("table").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x < y").select("table")
    return now.join(split, "table", "left_semi").select("class_id", "of").distinct()


def _bucket_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of the texts fall into each of a fixed number of hash buckets."""

    def count(batches):
        for batch in batches:
            sums = np.zeros(BUCKETS, np.int64)
            for hashes in shingle_sets(batch.column(0), shingle):
                np.add.at(sums, hashes % np.uint64(BUCKETS), 1)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def open_pairs(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that may reach the similarity; ``texts`` is (class_id, of, text).

    An exact filter: ordered by rarity, two sets of that similarity share one of their first shingles, as many as may differ and one
    more; the shorter set of a pair needs only those that could be missing from a set of its own size, the longer one only those that
    leave enough behind them for sets of the shorter one's band of sizes. A pair need not meet at a shingle when both have the same one before it, as it
    has met there: texts that share a run of shingles meet where the run begins. A passage that very many texts share is not among the
    rarest parts of a text unless it is nearly all of it, and texts of one component do not meet.
    """
    counts = _bucket_counts(texts, shingle)

    def prefixes(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                sets = shingle_sets(some.column(2), shingle)
                heads = []
                for one in sets:
                    held = len(one) + (-percent * len(one)) // 100 + 1
                    order = np.lexsort((one, counts[(one % np.uint64(BUCKETS)).astype(np.int64)]))
                    heads.append(one[order[:held]] if len(one) else one)
                sizes = [len(h) for h in heads]
                owner = np.repeat(np.arange(len(sets)), sizes)
                place = np.concatenate([np.arange(n) for n in sizes]) if heads else np.empty(0, np.int64)
                every = np.concatenate(heads).view(np.int64) if heads else np.empty(0, np.int64)
                before = pa.array(np.concatenate([every[:1], every[:-1]]), mask=place == 0)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    some.column(0).take(take), some.column(1).take(take), pa.array(np.array([len(x) for x in sets], np.int64)[owner]),
                    pa.array(every), pa.array(place, pa.int64()), before,
                ], names=["class_id", "of", "n", "shingle", "at", "before"])

    rows = texts.select("class_id", "of", "text").mapInArrow(
        prefixes, "class_id bigint, of bigint, n bigint, shingle bigint, at bigint, before bigint")
    rows = written(rows, "prefixes")
    short = F.expr(f"at < n + 1 - ({2 * percent} * n + {99 + percent}) div {100 + percent}")
    split = rows.groupBy("shingle").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.bool_or(short).alias("s")).filter("x < y AND s").select("shingle")
    rows = written(rows.join(split, "shingle", "left_semi"), "prefixes")
    one, two = ([F.col(c).alias(f"{side}_{c}") for c in ("class_id", "of", "n", "at", "before")] for side in "xy")

    def band(n):
        return F.floor(F.log(n) / math.log(max(100 / percent, 1.05))).cast("int")

    least = F.expr(f"({percent} * n + 99) div 100")
    most = F.least("n", F.expr(f"({100 + percent} * (n - at)) div {percent} - n"))
    asking = rows.filter(short).select("shingle", band(F.col("n")).alias("band"), *one)
    asked = rows.withColumns({"least": least, "most": most}).filter("least <= most").select(
        "shingle", F.explode(F.sequence(band(F.col("least")), band(F.col("most")))).alias("band"), *two)
    shorter = "(x_n < y_n OR (x_n = y_n AND x_class_id < y_class_id))"
    left = f"1 + least(x_n - x_at - 1, y_n - y_at - 1) >= ({percent} * (x_n + y_n) + {99 + percent}) div {100 + percent}"
    begins = "(x_before IS NULL OR y_before IS NULL OR x_before <> y_before)"
    on = [asking[c] == asked[c] for c in ("shingle", "band")]
    met = asking.join(asked, [*on, F.expr(f"x_of <> y_of AND {begins} AND {shorter} AND 100 * x_n >= {percent} * y_n AND {left}")])
    return met.select(F.least("x_class_id", "y_class_id").alias("a"), F.greatest("x_class_id", "y_class_id").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; ``texts`` is (class_id, text)."""
    one = texts.select(F.col("class_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("class_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "text_a", "text_b")

    def confirm(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = []
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                for x, y in zip(shingle_sets(some.column(2), shingle), shingle_sets(some.column(3), shingle)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept))
        give_back()

    return rows.mapInArrow(confirm, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Rows are linked when their sets of word shingles share ``percent`` percent of their union; A-Z are lowered, a text with fewer
    words than a shingle is one shingle. ``component_id`` is the smallest id reachable and ``kept`` marks that row.
    Equal sets form a class first and only classes are compared. In every table the smallest and the greatest class meet all
    others. Classes that still share a table with an unconnected one are joined exactly, by their rarest shingles. Texts that are NULL, empty or without words are linked with
    nothing, and so are rows without an id, whose component is NULL. Repeated rows are answered alike; rows that share an id but
    not the text are one document that is linked by any of its texts. Empty tables give empty tables.
    """
    signs = written(signatures(docs, doc_id, text, shingle, side, rows), "signatures")
    linked = signs.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(linked.groupBy("set_key").agg(
        F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    shared = written(tables(classes), "tables")

    # All texts that any later step looks at, in one join; it never turns into a broadcast, so it costs alike at every size.
    met = shared.select("class_id").distinct().hint("merge")
    own = docs.select(F.col(doc_id).cast("bigint").alias("class_id"), F.col(text).alias("text"))
    texts = written(own.join(met, "class_id", "left_semi"), "texts")

    first = written(pivot_pairs(shared, percent), "pairs")
    links = written(confirmed(first, texts, shingle, percent), "confirmed")
    found = components(links)
    unsettled = written(open_classes(shared, found), "open")
    if not unsettled.isEmpty():
        apart = written(texts.join(unsettled.hint("merge"), "class_id").select("class_id", "of", "text"), "texts")
        second = open_pairs(apart, shingle, percent)
        second = written(second.join(first, ["a", "b"], "left_anti"), "pairs")
        if not second.isEmpty():
            links = links.unionByName(written(confirmed(second, texts, shingle, percent), "confirmed"))
            found = components(links)
    members = classes.join(found, F.col("class_id") == F.col("node"), "left").select(
        "set_key", F.coalesce("component", "class_id").alias("component"))
    out = signs.join(members, "set_key", "left")
    alone = F.col("set_key").isNull() | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component left, the one with the smallest id; all columns stay.

    Rows without an id stay. Only the ids that go meet the documents.
    """
    flags = near_duplicates(docs, doc_id, text, **options)
    gone = written(flags.filter("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct(), "gone")
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
