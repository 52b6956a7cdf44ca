"""Distinct counts that can be kept per month and merged for any span."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SIZE = 12
# Standard deviations of the bounds that are given with an estimate.
DEVIATIONS = 3


def relative_error(log_size: int = LOG_SIZE) -> float:
    """Standard error of merged sketches as a share of the count: 1.04 over the root of the number of registers."""
    return 1.04 / math.sqrt(1 << log_size)


def month_sketches(df: DataFrame, month: Column, columns: Sequence[str], by: Sequence[str] = (), log_size: int = LOG_SIZE) -> DataFrame:
    """(month, by..., rows, <column>_sketch...): one row of a few kilobytes per month and group, merged where the rows lie. NULLs do not count."""
    sketches = [F.hll_sketch_agg(F.col(c), log_size).alias(f"{c}_sketch") for c in columns]
    return df.groupBy(month.alias("month"), *by).agg(F.count("*").alias("rows"), *sketches)


def append_sketches(df: DataFrame, path: str, month: Column, columns: Sequence[str], by: Sequence[str] = (), log_size: int = LOG_SIZE) -> None:
    """Add the sketches of new rows to the table at ``path``; what is stored already is not read again."""
    month_sketches(df, month, columns, by, log_size).write.mode("append").partitionBy("month").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))


def distinct_counts(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = (), log_size: int = LOG_SIZE) -> DataFrame:
    """(by..., rows, <column>, <column>_low, <column>_high) of the months given; filter ``sketches`` for a span.

    The bounds are ``DEVIATIONS`` standard errors wide. Sketches of the same month, as of several loads, merge like any others.
    """
    merged = [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(c) for c in columns]
    out = sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *merged)
    width = DEVIATIONS * relative_error(log_size)
    bounds = {f"{c}_{end}": rounded(F.col(c) * (1 + sign * width)).cast("long")
              for c in columns for end, sign, rounded in (("low", -1, F.floor), ("high", 1, F.ceil))}
    return out.withColumns(bounds)
