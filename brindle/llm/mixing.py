"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
PASSES = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
# One row per set of sources comes to the driver; more sets than this are an error, not a cut.
MAX_PATTERNS = 100_000
BUCKET_BITS = 16
NO_SOURCE = "n"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def pattern_key(sources: Column) -> Column:
    """Distinct source names in order, each marked so that a NULL name is a source of its own."""
    marked = F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit(NO_SOURCE)))
    return F.coalesce(F.array_sort(F.array_distinct(marked)), F.array().cast("array<string>"))


def source_order(name: str) -> tuple:
    """By code point, the NULL source last."""
    return (name == NO_SOURCE, name)


def water_filled(total: float, weights: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """``total`` shared by weight; what is above ``most`` goes to the others by weight until none is above."""
    full: set[str] = set()
    while True:
        left = total - sum(most[s] for s in full)
        weight = sum(w for s, w in weights.items() if s not in full)
        shares = {s: left * w / weight if weight > 0 else 0.0 for s, w in weights.items() if s not in full}
        above = {s for s, x in shares.items() if x > most[s]}
        if not above:
            return {s: most[s] if s in full else shares[s] for s in weights}
        full |= above


class Flow:
    """Maximum flow by shortest augmenting levels; capacities may be raised between runs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.head: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for start, end, r in ((a, b, room), (b, a, 0)):
            self.out[start].append(len(self.head))
            self.head.append(end)
            self.room.append(r)
        return len(self.head) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def augment(self, source: int, sink: int) -> int:
        total = 0
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for arc in self.out[a]:
                    b = self.head[arc]
                    if self.room[arc] and b not in level:
                        level[b] = level[a] + 1
                        queue.append(b)
            if sink not in level:
                return total
            turn = [0] * len(self.out)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    some = min(self.room[arc] for arc in path)
                    for arc in path:
                        self.room[arc] -= some
                        self.room[arc ^ 1] += some
                    total += some
                    del path[next(i for i, arc in enumerate(path) if not self.room[arc]) :]
                    at = self.head[path[-1]] if path else source
                while turn[at] < len(self.out[at]):
                    arc = self.out[at][turn[at]]
                    b = self.head[arc]
                    if self.room[arc] and level.get(b) == level[at] + 1:
                        path.append(arc)
                        at = b
                        break
                    turn[at] += 1
                else:
                    if not path:
                        break
                    arc = path.pop()
                    at = self.head[arc ^ 1]
                    turn[at] += 1


def routed(sizes: dict[tuple[str, ...], int], quotas: dict[str, int], passes: int = PASSES) -> dict[tuple[str, ...], int]:
    """Words each pattern gives, at least cost.

    Every pattern offers its words ``passes`` times; the k-th time costs k - 1 a word. As only these offers cost, filling the quotas
    as far as first offers reach, then opening second offers, and so on, is a flow of least cost among the greatest.
    """
    patterns, names = sorted(sizes), sorted(quotas)
    source, sink = 0, 1 + len(patterns) + len(names)
    number = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    flow = Flow(sink + 1)
    offers = []
    for i, p in enumerate(patterns, 1):
        offers.append(flow.arc(source, i, 0))
        for s in p:
            flow.arc(i, number[s], passes * sizes[p])
    for s in names:
        flow.arc(number[s], sink, quotas[s])
    for _ in range(passes):
        for arc, p in zip(offers, patterns):
            flow.room[arc] += sizes[p]
        flow.augment(source, sink)
    return {p: flow.used(arc) for arc, p in zip(offers, patterns)}


def plan(sizes: dict[tuple[str, ...], int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.0,
         passes: int = PASSES) -> tuple[dict, dict, dict]:
    """(words in each source, target of each source, words each pattern gives)."""
    names = sorted({s for p in sizes for s in p}, key=source_order)
    held = {s: sum(n for p, n in sizes.items() if s in p) for s in names}
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets = water_filled(share * sum(sizes.values()), weigh, {s: float(passes * held[s]) for s in names})
    return held, targets, routed(sizes, {s: int(t + 1e-6) for s, t in targets.items()}, passes)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sources: Column | None = None,
          weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, passes: int = PASSES, seed: int = SEED,
          into: str = "__mix") -> DataFrame:
    """``docs`` with a column ``into``: struct(size, source_size, target, taken).

    ``size`` counts words. Rows with the same set of sources form a pattern. A pattern gives its words as many whole times as
    its flow allows; the rest comes from its rows in the order of a seeded hash of the id, the last of them with its first
    words only. Only one row per pattern goes through the driver. Sums per hash bucket find where the order is cut; rows
    are ranked inside that bucket alone. ``source_size`` and ``target`` are those of the row's sources added up. No row is
    taken more than ``passes`` times. Without ``sources`` the column ``source`` is the only one of a row. A NULL source is one of its
    own, after all others; a row with no source at all is not taken. Empty and NULL texts have size 0. Reruns agree.
    """
    spark = docs.sparkSession
    size, key, bucket, place = "__size", "__pattern", "__bucket", "__place"
    own = docs.withColumns({size: word_count(F.col(text)), key: pattern_key(F.array("source") if sources is None else sources)})
    sums = own.groupBy(key).agg(F.sum(size).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    sizes = {tuple(r[key]): r["n"] for r in sums}
    held, targets, flows = plan(sizes, weights, share, passes)
    rows = [
        (list(p), sum(held[s] for s in p), float(sum(targets[s] for s in p)), flows[p] // max(1, n), flows[p] % max(1, n))
        for p, n in sorted(sizes.items())
    ]
    routes = spark.createDataFrame(rows, f"{key} array<string>, __held bigint, __target double, __whole bigint, __rest bigint")
    hashed = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(size))
    placed = own.join(F.broadcast(routes), key).withColumns({
        place: hashed, bucket: F.shiftrightunsigned(hashed, 64 - BUCKET_BITS).cast("int")})

    per_bucket = placed.filter("__rest > 0").groupBy(key, bucket, "__rest").agg(F.sum(size).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(bucket))
    cut = per_bucket.withColumn("upto", upto).filter("upto >= __rest AND upto - n < __rest").select(
        key, F.col(bucket).alias("__cut"), (F.col("__rest") - F.col("upto") + F.col("n")).alias("__open"))
    placed = placed.join(F.broadcast(cut), key, "left")

    apart = placed.withColumn("__part", F.when(F.col("__cut").isNull() | (F.col(bucket) > F.col("__cut")), F.lit(0)).otherwise(F.col(size)))
    inside = F.col("__cut").isNotNull() & (F.col(bucket) == F.col("__cut"))
    before = Window.partitionBy(key).orderBy(place, doc_id, size).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__open") - F.coalesce(F.sum(size).over(before), F.lit(0))
    edge = placed.filter(inside).withColumn("__part", F.greatest(F.lit(0), F.least(F.col(size), left)))
    both = apart.filter(~inside).unionByName(edge)
    return both.select(*docs.columns, F.struct(
        F.col(size).alias("size"), F.col("__held").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__whole") * F.col(size) + F.col("__part")).cast("bigint").alias("taken")).alias(into))


def mix_report(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs``; see ``mixed``."""
    return mixed(docs, doc_id, **options).select(F.col(doc_id).alias("doc_id"), "__mix.size", "__mix.source_size", "__mix.target", "__mix.taken")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as it is taken, always whole.

    The one row of a pattern that the mix takes in part is taken once more if that part is at least half of it, else not: whichever is nearer
    to the target. Rows of size 0 carry no words and are left out.
    """
    rows = mixed(docs, doc_id, text, **options).filter("__mix.taken > 0")
    times = rows.withColumn("__n", F.expr("cast((2 * __mix.taken + __mix.size) div (2 * __mix.size) as int)")).filter("__n > 0")
    return times.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)
