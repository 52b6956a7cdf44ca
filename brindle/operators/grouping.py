"""Totals at several levels in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.numbers import round_to

FUNCTIONS = ("count", "sum", "avg", "min", "max")


def rollup_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def cube_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(keys), -1, -1) for c in combinations(keys, n)]


def grouping_sets(
    df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], measures: dict[str, tuple[str, str | None]], having: Column | None = None,
    digits: int | None = 2,
) -> DataFrame:
    """Keys, ``total_<key>`` flags, ``level`` and the measures of every group of every set.

    ``measures`` are name -> (function, column), the function one of count, sum, avg, min and max; ("count", None) counts rows. Rows are reduced to one per
    full key first, and only those are copied for the sets, so neither the copies nor a total over everything grow with the rows. A
    subtotal's key is NULL with ``total_<key>`` 1; a NULL of the data has 0. ``level`` is the number of keys summed over. ``having`` holds for the
    result's columns. With no rows there is no group, also in the grand total.
    """
    unknown = [f for f, _ in measures.values() if f not in FUNCTIONS]
    if unknown or any(set(s) - set(keys) for s in sets):
        raise ValueError(f"functions are {FUNCTIONS}, sets consist of keys")

    def of(function: str, column: str | None) -> dict[str, Column]:
        c = F.lit(1) if column is None else F.col(column)
        parts = {"count": F.count(c), "sum": F.sum(c), "min": F.min(c), "max": F.max(c)}
        needed = ("sum", "count") if function == "avg" else (function,)
        return {n: parts[n] for n in needed}

    partial = df.groupBy(*keys).agg(*[c.alias(f"_{m}_{n}") for m, (f, col) in measures.items() for n, c in of(f, col).items()])
    whole = [F.col(k) for k in keys]

    def merged(name: str, function: str) -> Column:
        part = {n: f"_{name}_{n}" for n in FUNCTIONS}
        if function == "avg":
            value = F.try_divide(F.sum(part["sum"]), F.sum(part["count"]))
        else:
            value = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[function](part[function])
        return round_to(value, digits) if digits is not None and function in ("sum", "avg") else value

    flags = [F.grouping(k).cast("int").alias(f"total_{k}") for k in keys]
    level = sum((F.grouping(k).cast("int") for k in keys), F.lit(0)).alias("level")
    out = partial.groupingSets([[F.col(k) for k in s] for s in sets], *whole).agg(*flags, level, *[merged(n, f).alias(n) for n, (f, _) in measures.items()])
    return out.filter(having) if having is not None else out
