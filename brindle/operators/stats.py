"""Counts, rates, summaries, confusion measures and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.numbers import rate_band, risk_level, round_to, share_pct
from brindle.functions.predicates import non_blank, target_flag
from brindle.functions.text import money_or_plain

# Category columns looked at first, and text columns never used as categories.
PRIORITY_CATEGORIES = ("contract", "internet_service", "payment_method", "gender")
NOT_CATEGORIES = ("id", "source_file", "customerid", "customer_id")


def count_true(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("bigint")), F.lit(0))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def pick_categories(df: DataFrame, limit: int | None = None) -> list[str]:
    """Preferred names first, then the other text columns; ``limit`` stops at that many."""
    text = [
        f.name for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name.lower() not in NOT_CATEGORIES
    ]
    picked = []
    for wanted in PRIORITY_CATEGORIES:
        hit = next((c for c in text if wanted in c.lower()), None)
        if hit:
            picked.append(hit)
    for name in text:
        if name not in picked and (limit is None or len(picked) < limit):
            picked.append(name)
    return picked


def summary_stats(df: DataFrame, target: str | None, numeric: list[str] | None = None, k: int | None = None) -> DataFrame:
    """One row: total, positives, rate and the rounded mean of all numeric columns, or of the first ``k``."""
    chosen = (numeric if numeric is not None else numeric_columns(df))[:k]
    aggs = [F.count("*").alias("total")]
    if target:
        hit = count_true(target_flag(df, target))
        aggs += [hit.alias("positive"), share_pct(hit, F.count("*")).alias("rate")]
    aggs += [round_to(F.avg(c), 2).alias(f"avg_{c}") for c in chosen]
    return df.agg(*aggs)


def summary_text(stats: DataFrame) -> DataFrame:
    """The summary row as display strings: ``12.3%``, ``$1,234.50``, ``1,234.50``."""
    shown = [F.col("total")]
    if "rate" in stats.columns:
        rate = F.concat(F.format_number("rate", 1), F.lit("%"))
        shown += [F.col("positive"), F.coalesce(rate, F.lit("N/A")).alias("rate")]
    means = [c for c in stats.columns if c.startswith("avg_")]
    return stats.select(*shown, *[money_or_plain(c, F.col(c)).alias(c) for c in means])


def _category_counts(df: DataFrame, columns: list[str], target: str | None) -> DataFrame:
    flag = target_flag(df, target) if target else F.lit(False)
    tall = (
        df.select(flag.alias("_flag"), *[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot(["_flag"], list(columns), "column", "category")
        .filter(non_blank(F.col("category")))
    )
    return tall.groupBy("column", "category").agg(
        F.count("*").alias("total"), count_true(F.col("_flag")).alias("positive")
    )


def _largest(groups: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return groups
    order = Window.partitionBy("column").orderBy(F.desc("total"), F.asc("category"))
    return groups.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def category_rate(
    df: DataFrame, target: str, columns: list[str] | None = None, k: int | None = None
) -> DataFrame:
    """Total, positives and rate per category, all columns in one pass; ``k`` keeps the largest of each column."""
    counts = _largest(_category_counts(df, columns or pick_categories(df), target), k)
    return counts.withColumn("rate", share_pct(F.col("positive"), F.col("total")))


def category_count(df: DataFrame, columns: list[str] | None = None, k: int | None = None) -> DataFrame:
    return _largest(_category_counts(df, columns or pick_categories(df), None), k).drop("positive")


def corpus_stats(chunks: DataFrame, file: str, uploaded: str) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.countDistinct(file).alias("files"),
        F.min(uploaded).alias("first_upload"),
        F.max(uploaded).alias("last_upload"),
    )


def billing_summary(
    df: DataFrame, keys: list[str], rate: str, bandwidth: str, uploaded: str, k: int | None = None
) -> DataFrame:
    """All groups by key; with ``k`` only those with the largest total rate."""
    groups = (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("records"),
            round_to(F.avg(rate), 2).alias("avg_rate"),
            round_to(F.sum(rate), 2).alias("total_rate"),
            round_to(F.avg(bandwidth), 2).alias("avg_bandwidth"),
            F.min(uploaded).alias("first_upload"),
            F.max(uploaded).alias("last_upload"),
        )
    )
    return groups if k is None else groups.orderBy(F.desc("total_rate"), *keys).limit(k)


def billing_stats(
    df: DataFrame, keys: list[str], rate: str, uploaded: str, approximate: bool = False
) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(
        F.count("*").alias("records"),
        *[distinct(key).alias(f"distinct_{key}") for key in keys],
        round_to(F.avg(rate), 2).alias("avg_rate"),
        round_to(F.min(rate), 2).alias("min_rate"),
        round_to(F.max(rate), 2).alias("max_rate"),
        round_to(F.sum(rate), 2).alias("total_rate"),
        F.min(uploaded).alias("first_upload"),
        F.max(uploaded).alias("last_upload"),
    )


def combo_means(
    df: DataFrame, keys: list[str], firsts: list[str], means: list[str], order: Column
) -> DataFrame:
    """Per key: the first value by ``order`` and plain means."""
    return df.groupBy(*keys).agg(
        *[F.min(F.struct(order.alias("o"), F.col(c).alias("v")))["v"].alias(c) for c in firsts],
        *[F.avg(c).alias(c) for c in means],
    )


def risk_summary(scored: DataFrame, probability: str) -> DataFrame:
    level = risk_level(F.col(probability))
    return scored.agg(
        F.count("*").alias("total"),
        count_true(level == "HIGH").alias("high_risk"),
        count_true(level == "MEDIUM").alias("medium_risk"),
        count_true(level == "LOW").alias("low_risk"),
        share_pct(count_true(level == "HIGH"), F.count("*")).alias("high_share"),
    )


def confusion(scored: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """Cells and measures at one cut; 0 wherever a denominator is 0."""
    yes, said = F.col(label) == 1, F.col(score) >= cut
    return measures(scored.agg(
        count_true(yes & said).alias("tp"),
        count_true(~yes & ~said).alias("tn"),
        count_true(~yes & said).alias("fp"),
        count_true(yes & ~said).alias("fn"),
    ))


def measures(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 next to the four cells."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return cells.select(
        "tp", "tn", "fp", "fn",
        round_to(ratio(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"),
        round_to(precision, 4).alias("precision"),
        round_to(recall, 4).alias("recall"),
        round_to(ratio(2 * precision * recall, precision + recall), 4).alias("f1"),
    )


def prob_histogram(scored: DataFrame, probability: str, bins: int = 20) -> DataFrame:
    """Count per equal-width bin between the smallest and largest value; empty bins are absent."""
    p = F.col(probability).cast("double")
    edges = scored.agg(F.struct(F.min(p).alias("lo"), F.max(p).alias("hi"))).scalar()
    lo, hi = edges["lo"], edges["hi"]
    flat = F.lit(bins // 2 + 1)
    place = F.floor(F.lit(float(bins)) * (p - lo) / (hi - lo)).cast("int") + 1
    placed = scored.filter(p.isNotNull()).select(
        F.when(lo == hi, flat).otherwise(F.least(place, F.lit(bins))).alias("bin"),
        lo.alias("lo"), ((hi - lo) / bins).alias("width"),
    )
    return placed.groupBy("bin", "lo", "width").agg(F.count("*").alias("n")).select(
        "bin", "n", round_to(F.col("lo") + (F.col("bin") - 1) * F.col("width"), 6).alias("bin_start")
    )


def score_stats(scored: DataFrame, score: str, anomaly: Column) -> DataFrame:
    return scored.agg(
        round_to(F.avg(anomaly.cast("double")), 6).alias("anomaly_rate"),
        round_to(F.avg(score), 6).alias("mean_score"),
        round_to(F.stddev_pop(score), 6).alias("std_score"),
        F.count("*").alias("n"),
    )


# Tables behind the charts

# Fixed value: bars of a chart.
CHART_CATEGORIES = 15

def chart_distribution(df: DataFrame, target: str) -> DataFrame:
    """Exact total, positive and retained counts as (measure, n) rows."""
    hit = count_true(target_flag(df, target))
    wide = df.agg(
        F.count("*").alias("total"), hit.alias("positive"), (F.count("*") - hit).alias("retained")
    )
    return wide.unpivot([], ["total", "positive", "retained"], "measure", "n")


def chart_category(df: DataFrame, target: str, columns: list[str], tables: int = 3, label_chars: int = 15) -> DataFrame:
    rates = category_rate(df, target, columns[:tables], CHART_CATEGORIES)
    return rates.select(
        "column", F.left(F.col("category"), F.lit(label_chars)).alias("label"),
        "total", "rate", rate_band(F.col("rate")).alias("band"),
    )


def chart_importance(importance: DataFrame, k: int = 15) -> DataFrame:
    name = F.replace(F.col("feature"), F.lit("_encoded"), F.lit(""))
    return (
        importance.orderBy(F.desc("importance"), "feature").limit(k)
        .select(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("label"), "importance")
    )


def chart_risk(scored: DataFrame, probability: str, bins: int = 20) -> DataFrame:
    """Risk counts and histogram bins in one tall table (part, label, n)."""
    levels = scored.groupBy(risk_level(F.col(probability)).alias("label")).agg(F.count("*").alias("n"))
    histogram = prob_histogram(scored, probability, bins)
    return levels.select(F.lit("risk").alias("part"), "label", "n").unionByName(
        histogram.select(
            F.lit("histogram").alias("part"), F.lpad(F.col("bin").cast("string"), 2, "0").alias("label"), "n"
        )
    )




def data_fingerprint(df: DataFrame, columns: list[str], size: int = 8) -> DataFrame:
    """Order-free hash of the rows: one pass, partial sums per partition."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    part = F.conv(F.left(F.md5(row), F.lit(15)), 16, 10).cast("decimal(38,0)")
    mixed = F.concat_ws(":", F.coalesce(F.sum(part), F.lit(0)).cast("string"), F.count("*").cast("string"))
    return df.agg(F.left(F.md5(mixed), F.lit(size)).alias("fingerprint"))
