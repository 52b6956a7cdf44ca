"""Retraining with a version table: fingerprint, train, compare, record, roll back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.anomaly import Forest, fit_scores, load_forest, save_forest
from brindle.operators.stats import data_fingerprint, score_stats
from brindle.session import fresh_path, written

MIN_GAIN = 0.05
VERSIONS = "version string, model_path string, metrics map<string,double>, created_at timestamp, training_data_hash string, is_active boolean"


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VERSIONS)


def promotes(new: Column, old: Column, min_gain: float = MIN_GAIN) -> Column:
    """More than ``min_gain`` relative gain; anything beats a missing or non-positive old value."""
    gain = F.when(old > 0, (new - old) / old).otherwise(1.0)
    return gain > min_gain


def register(registry: DataFrame, candidate: DataFrame, min_gain: float = MIN_GAIN) -> DataFrame:
    """Registry with one more version.

    ``candidate`` is one row (metrics, training_data_hash, model_path, created_at). The new version
    becomes the active one when its score spread beats the active one's; the others then step back.
    """
    current = registry.filter("is_active").agg(
        F.max_by(F.col("metrics")["std_score"], "created_at").alias("old"), F.count("*").alias("n")
    )
    state = F.struct(current.select("old").scalar().alias("old"), current.select("n").scalar().alias("n"))
    count = registry.agg(F.count("*")).scalar()
    judged = candidate.withColumn("_s", state).withColumn(
        "is_active", (F.col("_s")["n"] == 0) | promotes(F.col("metrics")["std_score"], F.coalesce(F.col("_s")["old"], F.lit(0.0)), min_gain)
    )
    fresh = judged.select(
        F.concat(F.lit("v"), (count + 1).cast("string"), F.lit("_"), "training_data_hash").alias("version"),
        "model_path", "metrics", "created_at", "training_data_hash", "is_active",
    )
    promoted = fresh.agg(F.bool_or("is_active")).scalar()
    kept = registry.withColumn("is_active", F.col("is_active") & ~promoted)
    return kept.select(*fresh.columns).unionByName(fresh)


def rollback(registry: DataFrame, version: str) -> DataFrame:
    """Exactly the named version active; an unknown version changes nothing."""
    known = registry.agg(F.count_if(F.col("version") == version) > 0).scalar()
    return registry.withColumn("is_active", F.when(known, F.col("version") == version).otherwise(F.col("is_active")))


def retrain(
    registry: DataFrame, df: DataFrame, ids: list[str], columns: list[str], folder: str | None = None, min_gain: float = MIN_GAIN
) -> DataFrame:
    """One monthly run: fit a new forest, save it below ``folder`` (the work folder by default) and record the version."""
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}" if folder else fresh_path(spark, "forest")
    forest, scored = fit_scores(df, ids, columns)
    save_forest(spark, forest, path)
    stats = score_stats(scored, "score", F.col("anomaly"))
    entries = [F.lit(x) if isinstance(x, str) else x for c in stats.columns for x in (c, F.col(c).cast("double"))]
    candidate = stats.select(F.create_map(*entries).alias("metrics")).withColumns({
        "training_data_hash": data_fingerprint(df, ids + columns).scalar(),
        "model_path": F.lit(path), "created_at": F.current_timestamp(),
    })
    # the row is read several times below, and each read would train and score again
    return register(registry, written(candidate, "candidate"), min_gain)


def active_forest(registry: DataFrame) -> Forest:
    """The forest of the active version; ValueError when there is none."""
    row = registry.filter("is_active").orderBy(F.desc("created_at")).select("model_path").first()
    if row is None:
        raise ValueError("no version is active")
    return load_forest(registry.sparkSession, row["model_path"])
