"""Set operations that count repeated rows, and semi and anti joins with the rules of NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.joins import partitions

# Copies of one row that one task writes at a time.
COPIES = 100_000
# Bits of a Bloom filter per key, and at most; places that a key sets. The largest filter is 8 MB, whatever the tables hold.
BITS_PER_KEY, MOST_BITS, PLACES = 16, 1 << 26, 5


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    if len(left.columns) != len(right.columns):
        raise ValueError("both sides need the same number of columns")
    return right.select(*[F.col(r).cast(f.dataType).alias(f.name) for r, f in zip(right.columns, left.schema)])


def _balanced(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every distinct row with how often each side has it. Equal rows, NULLs included, are counted before they are shuffled."""
    both = left.withColumns({"_a": F.lit(1).cast("long"), "_b": F.lit(0).cast("long")}).unionAll(
        _aligned(left, right).withColumns({"_a": F.lit(0).cast("long"), "_b": F.lit(1).cast("long")}))
    return both.groupBy(*left.columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))


def _repeated(rows: DataFrame, times: Column, columns: Sequence[str]) -> DataFrame:
    """Each row ``times`` times; many copies of one row are written by many tasks."""
    lots = rows.withColumn("_n", times).filter("_n > 0").withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))))
    dealt = lots.repartition(partitions(rows), F.xxhash64(*columns), "_lot")
    size = F.least(F.lit(COPIES), F.col("_n") - F.col("_lot") * COPIES)
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size))).select(*columns)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides, each as often as the side that has fewer of it; NULLs are equal. Columns go by position, names are the left side's."""
    return _repeated(_balanced(left, right), F.least("_a", "_b"), left.columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the left side less those of the right, copy for copy; NULLs are equal."""
    return _repeated(_balanced(left, right), F.col("_a") - F.col("_b"), left.columns)


def _places(keys: Sequence[str], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(bits)) for i in range(PLACES)]


def bloom_words(keys: DataFrame) -> tuple[Column, int] | None:
    """(words, bits): the filter of a table of keys as an array of 64-bit words, None when they are too many for one."""
    n = keys.count()
    if not 0 < n * BITS_PER_KEY <= MOST_BITS:
        return None
    bits = 1 << max(6, (n * BITS_PER_KEY - 1).bit_length())
    places = keys.select(F.explode(F.array(*_places(keys.columns, bits))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("x"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    ordered = F.array_sort(F.collect_list(F.struct("w", F.coalesce("x", F.lit(0).cast("long")).alias("x"))))
    return every.agg(F.transform(ordered, lambda s: s["x"]).alias("words")).scalar(), bits


def may_match(df: DataFrame, keys: Sequence[str], filter_: tuple[Column, int]) -> Column:
    """False only where no key of the filter can be equal."""
    words, bits = filter_
    tests = [F.call_function("bit_get", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in _places(keys, bits)]
    return reduce(lambda a, b: a & b, tests)


def _known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _keys_of(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct keys of the right side, named and typed as the left side's."""
    return right.select(*[F.col(r).cast(left.schema[name].dataType).alias(name) for name, r in on]).distinct()


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], bloom: bool = True) -> DataFrame:
    """Left rows that have a partner; NULL keys have none. A Bloom filter of the right keys keeps most others from being shuffled."""
    names = [name for name, _ in on]
    keys = _keys_of(left, right, on).filter(_known(names))
    filter_ = bloom_words(keys) if bloom else None
    rows = left.filter(may_match(left, names, filter_)) if filter_ else left
    return rows.join(keys, names, "left_semi").select(*left.columns)


def _without(rows: DataFrame, keys: DataFrame, names: Sequence[str], bloom: bool) -> DataFrame:
    filter_ = bloom_words(keys) if bloom else None
    if filter_ is None:
        return rows.join(keys, list(names), "left_anti").select(*rows.columns)
    likely = F.coalesce(may_match(rows, names, filter_), F.lit(False)) & _known(names)
    return rows.filter(~likely).unionByName(rows.filter(likely).join(keys, list(names), "left_anti").select(*rows.columns))


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], nulls: str = "not_exists", bloom: bool = True) -> DataFrame:
    """Left rows without a partner.

    ``not_exists``: a NULL key has no partner, so its row stays. ``not_in``: the rules of NOT IN, a comparison with NULL is unknown
    and an unknown row goes: of one column, a NULL on the right leaves no row, a NULL on the left stays only if the right is empty; of
    several, a row goes when some right row is equal wherever both are known. Rows that the Bloom filter rules out stay without being shuffled.
    """
    names = [name for name, _ in on]
    keys = _keys_of(left, right, on)
    if nulls == "not_exists":
        return _without(left, keys.filter(_known(names)), names, bloom)
    if nulls != "not_in":
        raise ValueError("nulls is not_exists or not_in")

    def pattern(rows: DataFrame) -> DataFrame:
        """Which keys of a row are known, as bits."""
        bits = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") * (1 << i) for i, n in enumerate(names)])
        return rows.withColumn("_p", bits)

    lefts, rights = pattern(left), pattern(keys)
    theirs = sorted(r[0] for r in rights.select("_p").distinct().collect())
    out = None
    for ours in range(1 << len(names)):
        rows = lefts.filter(F.col("_p") == ours).drop("_p")
        for other in theirs:
            both = [n for i, n in enumerate(names) if ours & other & (1 << i)]
            if not both:
                rows = rows.filter(F.lit(False))
                continue
            rows = _without(rows, rights.filter(F.col("_p") == other).select(*both).distinct(), both, bloom)
        out = rows if out is None else out.unionByName(rows)
    return out
