"""Ranks over a whole table without a window over the whole table.

Rows are dealt into sorted ranges, ties cut at random so that no value is too much for a range; ranks inside a range are shifted by
what one row per range tells of the ranges before and after it: their rows, their distinct values, and whether a tie goes on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.joins import in_ranges
from brindle.session import written

SHIFTS = "_range int, _before long, _distinct long, _continues boolean, _tied_rank long, _tied_upto long, _n long"


def global_ranks(df: DataFrame, order: Sequence[str], descending: bool = False, ties: Sequence[str] = (), tiles: int | None = None) -> DataFrame:
    """Adds ``row_number``, ``rank``, ``dense_rank``, ``percent_rank``, ``cume_dist`` and, with ``tiles``, ``ntile``.

    Ranks go by ``order``; rows of one rank are numbered by ``ties``, those without difference in any order. NULLs come first, descending last.
    """
    way = F.desc if descending else F.asc
    by_value = [way(c) for c in order]
    dealt = in_ranges(df, [*by_value, *map(F.asc, ties)])
    inside = Window.partitionBy("_range")
    local = dealt.withColumns({
        "_row": F.row_number().over(inside.orderBy(*by_value, *map(F.asc, ties))), "_rank": F.rank().over(inside.orderBy(*by_value)),
        "_dense": F.dense_rank().over(inside.orderBy(*by_value)),
    })
    local = written(local, "ranks")
    value = F.struct(*order)
    ends = local.groupBy("_range").agg(
        F.count("*").alias("n"), F.max("_dense").alias("distinct"), F.min_by(value, "_row").alias("first"), F.max_by(value, "_row").alias("last"),
        F.max("_rank").alias("last_rank"), F.max(F.when(F.col("_rank") == 1, F.col("_row"))).alias("first_upto"))
    # one row per range
    before = F.lag("last").over(Window.orderBy("_range"))
    rows = ends.select("_range", "n", "distinct", "last_rank", "first_upto", (F.col("first").eqNullSafe(before) & before.isNotNull()).alias("continues")).orderBy("_range").collect()
    shifts = df.sparkSession.createDataFrame(_shifts(rows), SHIFTS)
    total = sum(r["n"] for r in rows)
    placed = local.join(F.broadcast(shifts), "_range")
    tied = F.col("_continues") & (F.col("_rank") == 1)
    rank = F.when(tied, F.col("_tied_rank")).otherwise(F.col("_before") + F.col("_rank"))
    upto = F.max("_row").over(inside.orderBy(*by_value).rangeBetween(Window.unboundedPreceding, Window.currentRow)) if len(order) == 1 else F.max(
        "_row").over(Window.partitionBy("_range", "_rank"))
    number = (F.col("_before") + F.col("_row")).cast("long")
    out = placed.withColumn("_upto", upto).select(
        *df.columns, number.alias("row_number"), rank.cast("long").alias("rank"),
        (F.col("_distinct") + F.col("_dense") - F.col("_continues").cast("int")).cast("long").alias("dense_rank"),
        ((rank - 1) / F.lit(float(max(1, total - 1)))).alias("percent_rank"),
        (F.when(F.col("_upto") == F.col("_n"), F.col("_tied_upto")).otherwise(F.col("_before") + F.col("_upto")) / F.lit(float(max(1, total)))).alias("cume_dist"),
    )
    return out.withColumn("ntile", _tile(F.col("row_number"), total, tiles)) if tiles else out


def _shifts(rows: list) -> list[tuple]:
    """What each range adds to its own ranks, from one row per range in order."""
    out, before, distinct, tied = [], 0, 0, 0
    for r in rows:
        own = before + r["last_rank"] if r["distinct"] > 1 or not r["continues"] else tied
        out.append([r["_range"], before, distinct, r["continues"], tied, 0, r["n"]])
        before, distinct, tied = before + r["n"], distinct + r["distinct"] - r["continues"], own
    # where the last value of a range ends, which may be ranges further on
    upto = before
    for place in range(len(rows) - 1, -1, -1):
        following = rows[place + 1] if place + 1 < len(rows) else None
        if following is None or not following["continues"]:
            upto = out[place][1] + rows[place]["n"]
        elif following["distinct"] > 1:
            upto = out[place + 1][1] + following["first_upto"]
        out[place][5] = upto
    return [tuple(o) for o in out]


def _tile(number: Column, total: int, tiles: int) -> Column:
    """The first groups get one row more when the rows do not divide evenly."""
    size, more = divmod(total, tiles)
    wide = more * (size + 1)
    small = F.lit(more) + F.ceil((number - wide) / F.lit(max(1, size)))
    return F.when(number <= wide, F.ceil(number / F.lit(size + 1))).otherwise(small).cast("int")
