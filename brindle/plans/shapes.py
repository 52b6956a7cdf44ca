"""Named query shapes: every function takes a table plus column names and returns a small report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.numbers import round_to, share_pct
from brindle.functions.predicates import all_of
from brindle.operators.stats import count_true


def count_where(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(all_of(list(conditions))).agg(F.count("*").alias("n"))


def percent_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(share_pct(count_true(F.coalesce(condition, F.lit(False))), F.count("*"), 2).alias("percent"))


def rate(df: DataFrame, flag: Column, *conditions: Column) -> DataFrame:
    rows = df.filter(all_of(list(conditions)))
    return rows.agg(
        F.count("*").alias("total"), count_true(flag).alias("positive"),
        share_pct(count_true(flag), F.count("*"), 2).alias("rate"),
    )


def average(df: DataFrame, value: str) -> DataFrame:
    return df.agg(round_to(F.avg(value), 2).alias("average"))


def group_count(df: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return out.limit(k) if k else out


def group_rate(df: DataFrame, flag: Column, keys: list[str], k: int | None = None) -> DataFrame:
    out = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("total"), count_true(flag).alias("positive"))
        .withColumn("rate", share_pct(F.col("positive"), F.col("total"), 2))
        .orderBy(F.desc("rate"), *keys)
    )
    return out.limit(k) if k else out


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Count and share per value; the grand total is a second aggregate over the small counts."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", share_pct(F.col("n"), total, 2))


def group_value(df: DataFrame, keys: list[str], value: str, agg: str) -> DataFrame:
    fn = {"sum": F.sum, "avg": F.avg}[agg]
    return df.groupBy(*keys).agg(round_to(fn(value), 2).alias(f"{agg}_value"))


def compare_groups(df: DataFrame, flag: Column, value: str) -> DataFrame:
    """Mean of a value with and without the flag, side by side."""
    return df.agg(
        round_to(F.avg(F.when(flag, F.col(value))), 2).alias("with_flag"),
        round_to(F.avg(F.when(~flag, F.col(value))), 2).alias("without_flag"),
        round_to(
            F.avg(F.when(flag, F.col(value))) - F.avg(F.when(~flag, F.col(value))), 2
        ).alias("difference"),
    )


def recent_positive(df: DataFrame, flag: Column, ts: str, as_of: Column, months: int = 3) -> DataFrame:
    since = F.add_months(as_of.cast("date"), -months)
    return df.filter(F.col(ts).cast("date") >= since).agg(count_true(flag).alias("n"))
