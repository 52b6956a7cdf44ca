"""Exact quantiles without sorting the table or holding its values in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
SMALL = 1_000_000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], small: int = SMALL
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each column, nulls ignored.

    A column with more than ``small`` values is narrowed first: a sketch gives two values around
    the wanted rank, the rows between them are counted, and the step repeats on those rows until
    few enough are left for an exact aggregate. Only counts and bounds reach the driver.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    light = [c for c in columns if counts[c] <= small]
    found: dict[str, list[float | None]] = {}
    if light:
        row = df.agg(*[
            F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs])).alias(c) for c in light
        ]).first()
        found = {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in light}
    for c in columns:
        if c not in found:
            values = df.select(F.col(c).cast("double").alias("v")).filter("v IS NOT NULL")
            found[c] = [_one(values, counts[c], p, small) for p in probs]
    return found


def _one(values: DataFrame, n: int, p: float, small: int) -> float:
    rank = p * (n - 1)
    low, high = math.floor(rank), math.ceil(rank)
    a = _value_at(values, n, low, small)
    b = a if high == low else _value_at(values, n, high, small)
    return a + (b - a) * (rank - low)


def _value_at(values: DataFrame, n: int, k: int, small: int) -> float:
    """Value of the 0-based rank ``k``."""
    rows = values
    while n > small:
        slack = 2.0 / SKETCH_ACCURACY
        at = k / max(n - 1, 1)
        around = [max(0.0, at - slack), min(1.0, at + slack)]
        lo, hi = rows.agg(F.percentile_approx("v", around, SKETCH_ACCURACY)).first()[0]
        below, inside = rows.agg(
            F.count_if(F.col("v") < lo), F.count_if(F.col("v").between(lo, hi))
        ).first()
        if lo == hi and below <= k < below + inside:
            return lo
        if not below <= k < below + inside or inside == n:
            break  # the sketch gave no tighter bounds
        rows, n, k = rows.filter(F.col("v").between(lo, hi)), inside, k - below
    # few rows, or few distinct values: grouped counts keep the final step small
    counted = rows.groupBy("v").agg(F.count("*").alias("c"))
    q = k / max(n - 1, 1)
    return counted.agg(F.percentile("v", F.lit(q), F.col("c"))).first()[0]
