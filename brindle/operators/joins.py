"""Joins by order and by range: as-of, point in interval, interval overlap.

None of them puts an entity, or all rows, into one task. As-of joins deal both sides together into ranges of (entity, time) and
carry the last value over range borders, at most one row per border. Range joins turn the inequality into an equality on bins, whose
width follows the length of each interval, and compare exactly within a bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import written

DIRECTIONS = ("backward", "forward", "nearest")
# Bins of one level are so many times as wide as those of the level below.
WIDER = 8
# Pairs in a common bin that a task of a range join compares, a few seconds' work.
PAIRS_PER_TASK = 1 << 22


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def no_clash(left: DataFrame, right: Sequence[str]) -> None:
    both = {c.lower() for c in left.columns} & {c.lower() for c in right}
    if both:
        raise ValueError(f"rename columns that both sides have: {sorted(both)}")


# A key with more than one in so many rows is frequent, so there are fewer frequent keys than this.
FREQUENT = 1000


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """Columns of ``per_key``, which has one row per key and its number of rows in ``count``, added to ``rows``. NULL keys match NULL ones.

    Frequent keys, fewer than ``FREQUENT`` whatever the size, are broadcast; rows of all others are joined by key, where no
    key holds more than one in ``FREQUENT`` rows. ``count`` is not returned. ``how`` is inner or left.
    """
    renamed = {k: f"_k_{k}" for k in keys}
    table = written(per_key.withColumnsRenamed(renamed), "per-key")
    many = F.col(count) * FREQUENT > (table.agg(F.sum(count)).first()[0] or 0)
    match = _all([F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    found = [c for c in per_key.columns if c not in (*keys, count)]
    frequent = table.filter(many)
    hot = rows.join(F.broadcast(frequent), match, "inner").select(*rows.columns, *found)
    rest = rows.join(F.broadcast(frequent.select(*renamed.values())), match, "left_anti")
    return hot.unionByName(rest.join(table.filter(~many), match, how).select(*rows.columns, *found))


def in_ranges(df: DataFrame, order: Sequence[Column], out: str = "_range") -> DataFrame:
    """Rows dealt into ranges of ``order`` of about equal size, whatever one value holds, the number of the range in ``out``.

    Bounds come from a sample of the rows; rows are written once, as their range must not change. Equal rows part at random.
    """
    dealt = df.withColumn("_deal", F.rand(7)).repartitionByRange(partitions(df), *order, F.asc("_deal"))
    return written(dealt.drop("_deal").withColumn(out, F.spark_partition_id()), "ranges")


def _matched(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str], columns: Sequence[str], ties: Sequence[str],
    backward: bool, allow_equal: bool, null_safe: bool, out: str,
) -> DataFrame:
    """``left`` with the matching right row as struct ``out``, NULL where there is none."""
    keys = [f"_k{i}" for i in range(len(by))]
    order_names = [f"_o{i}" for i in range(len(ties))]
    kind = left.schema[left_time].dataType
    usable_left = F.col(left_time).isNotNull() & _all([] if null_safe else [F.col(k).isNotNull() for k in by])
    usable_right = F.col(right_time).isNotNull() & _all([] if null_safe else [F.col(k).isNotNull() for k in by])
    named = [F.col(k).alias(n) for k, n in zip(by, keys)]
    # a right row comes before a left row of the same time when it may match it
    first, second = (0, 1) if allow_equal else (1, 0)
    lefts = left.filter(usable_left).select(
        *named, F.col(left_time).alias("_t"), F.lit(second).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in zip(ties, order_names)],
        F.struct(*left.columns).alias("_l"))
    rights = right.filter(usable_right).select(
        *named, F.col(right_time).cast(kind).alias("_t"), F.lit(first).alias("_side"), *[F.col(c).alias(n) for c, n in zip(ties, order_names)],
        F.struct(*[F.col(c) for c in columns], F.col(right_time).cast(kind).alias("_at")).alias("_r"))
    way = F.asc if backward else F.desc
    order = [way("_t"), F.asc("_side"), *[way(c) for c in order_names]]
    both = lefts.unionByName(rights, allowMissingColumns=True)
    dealt = in_ranges(both, [*map(F.asc, keys), *order])
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("_m", F.last("_r", ignorenulls=True).over(within)).filter("_l IS NOT NULL")
    # What an entity leaves behind at the end of a range. Ranges are sorted, so only the first entity of a range continues an
    # earlier one: the table to broadcast has one row per range at most.
    best = F.max_by if backward else F.min_by
    ends = dealt.groupBy(*keys, "_range").agg(best("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", *order_names))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_carry")).filter("_carry IS NOT NULL")
    carried = carried.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("_range").alias("_rangec"), "_carry")
    same = _all([F.col(k).eqNullSafe(F.col(f"{k}c")) for k in keys]) & (F.col("_range") == F.col("_rangec"))
    found = seen.join(F.broadcast(carried), same, "left")
    found = found.select("_l.*", F.coalesce("_m", "_carry").alias(out))
    return found.unionByName(left.filter(~usable_left), allowMissingColumns=True)


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str] = (), columns: Sequence[str] | None = None,
    ties: Sequence[str] = (), direction: str = "backward", tolerance: timedelta | float | None = None, allow_equal: bool = True,
    how: str = "left", null_safe: bool = False,
) -> DataFrame:
    """Every left row with the right row of the same entity nearest in time.

    ``backward`` takes the last right row at or before the left row's time, ``forward`` the first at or after it, ``nearest`` the
    closer of the two, the earlier one if both are as close. Of right rows of one time the last by ``ties`` is taken
    backward and the first forward; without ``ties`` any of them. ``allow_equal=False`` leaves out the same time; ``tolerance`` is the
    largest distance in time that still matches. NULL entities match nothing unless ``null_safe``; a NULL time
    matches nothing. ``columns`` of the right side are added (default: all but ``by``), NULL where nothing matches; with ``how="inner"`` such rows
    go. One entity may hold any share of the rows.
    """
    if direction not in DIRECTIONS or how not in ("left", "inner"):
        raise ValueError(f"direction is one of {DIRECTIONS}, how is left or inner")
    columns = [c for c in right.columns if c not in by] if columns is None else list(columns)
    no_clash(left, columns)
    if not by:  # one entity
        alone = asof_join(
            left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1)), left_time, right_time, ["_one"], columns, ties, direction,
            tolerance, allow_equal, how, null_safe)
        return alone.drop("_one")

    def matched(rows: DataFrame, backward: bool, out: str) -> DataFrame:
        return _matched(rows, right, left_time, right_time, by, columns, ties, backward, allow_equal, null_safe, out)

    def apart(match: str, backward: bool) -> Column:
        at = F.col(match)["_at"]
        return F.col(left_time) - at if backward else at - F.col(left_time)

    if direction == "nearest":
        rows = matched(matched(left, True, "_back"), False, "_ahead")
        closer = F.col("_back").isNull() | (F.col("_ahead").isNotNull() & (apart("_ahead", False) < apart("_back", True)))
        chosen, distance = F.when(closer, F.col("_ahead")).otherwise(F.col("_back")), F.when(closer, apart("_ahead", False)).otherwise(apart("_back", True))
    else:
        rows = matched(left, direction == "backward", "_match")
        chosen, distance = F.col("_match"), apart("_match", direction == "backward")
    if tolerance is not None:
        chosen = F.when(distance <= F.lit(tolerance), chosen)
    rows = rows.select(*left.columns, chosen.alias("_chosen"))
    if how == "inner":
        rows = rows.filter("_chosen IS NOT NULL")
    return rows.select(*left.columns, *[F.col("_chosen")[c].alias(c) for c in columns])


def _axis(column: str, kind: T.DataType) -> Column:
    """A number that never falls while the column grows; binning needs no more than that."""
    c = F.col(column)
    if isinstance(kind, T.TimestampNTZType):
        return (F.unix_date(c.cast("date")) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(c).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise ValueError(f"no range join on {kind.simpleString()}")


def _spans(df: DataFrame, start: str, end: str, keys: Sequence[str], names: Sequence[str], mark: str) -> DataFrame:
    """Rows as struct ``mark`` with their entity, start and end on the axis; rows that can match nothing are left out."""
    s, e = _axis(start, df.schema[start].dataType), _axis(end, df.schema[end].dataType)
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], s.alias(f"{mark}s"), e.alias(f"{mark}e"), F.struct(*df.columns).alias(mark),
                     (F.col(start) <= F.col(end)).alias("_sound"))
    some = [F.col(n).isNotNull() for n in names] + [~F.isnan(f"{mark}s"), ~F.isnan(f"{mark}e")]
    return rows.filter("_sound").drop("_sound").filter(_all(some))


class _Grid:
    """Bin widths per level, and how many ways the bins of a level are split."""

    def __init__(self, low: float, high: float, width: float, parts: int):
        self.low, self.span, self.width, self.parts = low, max(high - low, 0.0), width, parts

    def level(self, s: Column, e: Column) -> Column:
        """The level whose bins are at least as wide as the interval, which so meets two or three of them."""
        return F.greatest(F.ceil(F.log((e - s) / self.width) / math.log(WIDER)), F.lit(0)).cast("int")

    def levels(self, used: list[int]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("level"), F.lit(w).alias("width"), F.lit(self.salts(w)).alias("salts"))
                         for n in used for w in [self.width * WIDER**n]])

    def salts(self, width: float) -> int:
        """Wide bins hold as many points as narrow ones when each is split in proportion to its share of the axis."""
        return min(self.parts, max(1, math.ceil(self.parts * width / self.span))) if self.span else self.parts

    def bins(self, s: Column, e: Column, width: Column) -> Column:
        return F.sequence(F.floor((s - self.low) / width), F.floor((e - self.low) / width))


def _meet(visitors: DataFrame, owners: DataFrame, names: Sequence[str], grid: _Grid, least: Column, condition: Column) -> DataFrame:
    """Pairs of structs ``_v`` and ``_o``. Owners stand in the bins of their own level, visitors in those of all levels from ``least`` on.

    A pair that shares several bins is taken in the one where the later of the two starts.
    """
    own = owners.withColumn("_level", grid.level(F.col("_os"), F.col("_oe")))
    used = sorted(r[0] for r in own.select("_level").distinct().collect())
    if not used:
        return visitors.join(owners, names or F.lit(False), "inner").filter("false")
    rows = own.withColumn("_at", F.element_at(F.filter(grid.levels(used), lambda x: x["level"] == F.col("_level")), 1))
    rows = rows.withColumn("_bin", F.explode(grid.bins(F.col("_os"), F.col("_oe"), F.col("_at")["width"])))
    rows = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_at")["salts"] - 1)))
    rows = rows.select(*names, "_level", "_bin", "_salt", F.col("_at")["width"].alias("_width"), "_os", "_o")
    come = visitors.withColumn("_row", F.monotonically_increasing_id())
    come = come.withColumn("_at", F.explode(F.filter(grid.levels(used), lambda x: x["level"] >= least)))
    come = come.withColumn("_bin", F.explode(grid.bins(F.col("_vs"), F.col("_ve"), F.col("_at")["width"])))
    come = come.select(*names, F.col("_at")["level"].alias("_level"), "_bin", F.pmod("_row", F.col("_at")["salts"]).cast("int").alias("_salt"), "_vs", "_v")
    cells = [*names, "_level", "_bin", "_salt"]
    per_cell = come.groupBy(*cells).agg(F.count("*").alias("_a")).join(rows.groupBy(*cells).agg(F.count("*").alias("_b")), cells)
    tasks = math.ceil((per_cell.agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0) / PAIRS_PER_TASK)
    if tasks > 1:
        # few bytes may make many pairs, so tasks are not put together by what they read
        come, rows = (side.repartition(max(tasks, grid.parts), *cells) for side in (come, rows))
    met = come.join(rows, cells)
    first = F.floor((F.greatest("_vs", "_os") - grid.low) / F.col("_width"))
    return met.filter((F.col("_bin") == first) & condition).select("_v", "_o")


def _clipped(rows: DataFrame, mark: str, low: float, high: float) -> DataFrame:
    """Intervals cut to where the other side is; those beyond it go. An open end costs no more bins than a closed one."""
    s, e = f"{mark}s", f"{mark}e"
    inside = rows.filter((F.col(s) <= high) & (F.col(e) >= low))
    return inside.withColumns({s: F.greatest(s, F.lit(low)), e: F.least(e, F.lit(high))})


def _extent(rows: DataFrame, mark: str, others: DataFrame, other_mark: str) -> tuple[float, float] | None:
    """Finite bounds of ``rows``, None without rows. Where rows reach to infinity, all finite ends of the others lie within."""
    def finite(table: DataFrame, m: str):
        ends = [F.when(F.abs(f"{m}{x}") != math.inf, F.col(f"{m}{x}")) for x in "se"]
        return table.agg(F.count("*"), F.min(F.least(*ends)), F.max(F.greatest(*ends)), F.min(f"{m}s"), F.max(f"{m}e")).first()

    n, low, high, least, most = finite(rows, mark)
    if not n:
        return None
    if math.inf in (-least, most):
        _, other_low, other_high, _, _ = finite(others, other_mark)
        lows, highs = [x for x in (low, other_low) if x is not None], [x for x in (high, other_high) if x is not None]
        low, high = min(lows, default=0.0), max(highs, default=0.0)
    return low, high


def _width(rows: DataFrame, mark: str, low: float, high: float) -> float:
    """The median length, which makes most intervals narrow; it bears on speed alone."""
    middle = rows.agg(F.percentile_approx(F.col(f"{mark}e") - F.col(f"{mark}s"), 0.5, 1000), F.count("*")).first()
    return middle[0] or (high - low) / max(1, middle[1]) or 1.0


def _compare(closed: str, point: Column, start: Column, end: Column) -> Column:
    after = point >= start if closed in ("both", "left") else point > start
    return after & (point <= end if closed in ("both", "right") else point < end)


def range_join(
    points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: Sequence[tuple[str, str]] = (), closed: str = "both",
    how: str = "inner", key: Sequence[str] = (),
) -> DataFrame:
    """Every point with every interval that holds it, columns of both.

    ``by`` are pairs of columns that must be equal; NULL keys, points, starts and ends match nothing, nor do NaN and intervals that
    end before they start. ``closed`` tells which ends belong to an interval: both, left, right or neither. ``how="left"`` keeps
    points without an interval; it needs ``key``, columns that tell the points apart. Intervals live in bins of about their own length; a
    long one in few wide bins, which are split so that no task holds more than a fair share of the points.
    """
    if closed not in ("both", "left", "right", "neither") or how not in ("inner", "left") or (how == "left" and not key):
        raise ValueError("closed is both, left, right or neither; how is inner, or left with a key")
    no_clash(points, intervals.columns)
    names = [f"_k{i}" for i in range(len(by))]
    visitors = _spans(points, point, point, [a for a, _ in by], names, "_v")
    owners = _spans(intervals, start, end, [b for _, b in by], names, "_o")
    extent = _extent(visitors, "_v", owners, "_o")
    if extent is None:
        pairs = points.join(intervals, F.lit(False), "inner")
    else:
        low, high = extent
        visitors, owners = _clipped(visitors, "_v", low, high), _clipped(owners, "_o", low, high)
        grid = _Grid(low, high, _width(owners, "_o", low, high), partitions(points))
        inside = _compare(closed, F.col("_v")[point], F.col("_o")[start], F.col("_o")[end])
        pairs = _meet(visitors, owners, names, grid, F.lit(0), inside).select("_v.*", "_o.*")
    if how == "inner":
        return pairs
    pairs = written(pairs, "pairs")
    return pairs.unionByName(points.join(pairs.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)


def interval_join(
    left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, by: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Every pair of a left and a right interval that share at least one point, both ends included; columns of both.

    Keys and unusable rows as in ``range_join``. A pair meets at the level of the longer of the two: once as the right one is at least as
    long, once as the left one is longer, so neither side is copied for the other's short intervals.
    """
    no_clash(left, right.columns)
    names = [f"_k{i}" for i in range(len(by))]
    lefts = _spans(left, left_start, left_end, [a for a, _ in by], names, "_v")
    rights = _spans(right, right_start, right_end, [b for _, b in by], names, "_o")
    extent = _extent(lefts, "_v", rights, "_o")
    if extent is not None:
        rights = _clipped(rights, "_o", *extent)
        extent = _extent(rights, "_o", lefts, "_v")
    if extent is None:
        return left.join(right, F.lit(False), "inner")
    low, high = extent
    lefts = _clipped(lefts, "_v", low, high)
    grid = _Grid(low, high, _width(rights, "_o", low, high), partitions(left))
    share = (F.col("_v")[left_start] <= F.col("_o")[right_end]) & (F.col("_o")[right_start] <= F.col("_v")[left_end])
    level = grid.level(F.col("_vs"), F.col("_ve"))
    one = _meet(lefts, rights, names, grid, level, share).select("_v.*", "_o.*")

    def turned(rows: DataFrame, old: str, new: str) -> DataFrame:
        return rows.withColumnsRenamed({f"{old}s": f"{new}s", f"{old}e": f"{new}e", old: new})

    share = (F.col("_o")[left_start] <= F.col("_v")[right_end]) & (F.col("_v")[right_start] <= F.col("_o")[left_end])
    other = _meet(turned(rights, "_o", "_v"), turned(lefts, "_v", "_o"), names, grid, level + 1, share).select("_o.*", "_v.*")
    return one.unionByName(other)
