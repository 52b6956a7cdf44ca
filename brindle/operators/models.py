"""Classification and rate regression with MLlib, exact splits and exact measures."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import clip, recommendation, risk_level, round_to
from brindle.functions.predicates import POSITIVE_TARGETS, target_flag
from brindle.operators.schema import select_features
from brindle.operators.series import with_position
from brindle.operators.stats import count_true, measures
from brindle.session import written

SEED, TRAIN_SHARE, TREES = 42, 0.8, 100
MIN_CLASSIFIER_ROWS, MIN_REGRESSOR_ROWS = 50, 10
UNKNOWN = "Unknown"
PERFECT = 0.99
TREE_MEMORY_MB = 1_024
# A fit of more single rows than these reads them from files and counts fewer nodes at a time, so that their counts stay in the cache.
FEW_ROWS, CACHED_MB = 500_000, 4
MIN_LEAF_ROWS = 5
# Values that MLlib's trees tell apart in a feature, its default number of bins.
BINS = 32
# Rows that trees cannot tell apart are merged where that leaves at most one in so many.
MERGED_ROWS = 4


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline with what is needed to score and to describe it."""

    model: PipelineModel
    features: list[str]
    target: str
    metrics: DataFrame | None
    codes: dict[str, DataFrame]


# Targets, codes and splits

def binary_target(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """0/1 outcome; refuses a column that has not exactly two values."""
    values = df.select(column).distinct().limit(3).count()
    if values != 2:
        raise ValueError(f"{column} must have exactly 2 values")
    return df.withColumn(out, target_flag(df, column, POSITIVE_TARGETS).cast("int"))


def label_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code): alphabetical codes from 0, nulls as one more value; numbered by ranges, never in one task."""
    found = df.select(F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN)).alias("value")).distinct()
    return with_position(found, [], [F.asc("value")], out="code")


def encode_labels(df: DataFrame, columns: list[str], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds ``<column>_encoded``; a value missing from the code table gets 0."""
    out = df
    for c in columns:
        codes = (tables or {}).get(c)
        codes = (label_table(df, c) if codes is None else codes).toDF(f"_{c}", f"{c}_encoded")
        key = F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
        out = out.join(codes, key == F.col(f"_{c}"), "left").drop(f"_{c}")
        out = out.withColumn(f"{c}_encoded", F.coalesce(F.col(f"{c}_encoded"), F.lit(0)))
    return out


def _hash(ids: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def split_stratified(
    df: DataFrame, ids: list[str], label: str, share: float = TRAIN_SHARE, seed: int = SEED
) -> DataFrame:
    """Adds ``is_train``: exactly ``round(share * n)`` rows of each class, chosen by hash order.

    Hash buckets are counted per class; whole buckets below the cut go to the training side and
    only the one bucket on the cut is ranked.
    """
    # digits of one length order as the numbers do; 65,536 buckets of a class are counted in the cache
    hashed = df.withColumns({"_h": _hash(ids, seed)}).withColumn("_b", F.substring("_h", 1, 4))
    counts = hashed.groupBy(F.col(label).alias("_class"), "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_class").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.floor(F.sum("_n").over(Window.partitionBy("_class")) * share + 0.5)
    edges = (
        counts.withColumns({"_cum": F.sum("_n").over(upto), "_k": wanted})
        .filter((F.col("_cum") - F.col("_n") < F.col("_k")) & (F.col("_k") <= F.col("_cum")))
        .select("_class", F.col("_b").alias("_edge"), (F.col("_k") - F.col("_cum") + F.col("_n")).alias("_need"))
    )
    # one row per class
    placed = hashed.join(F.broadcast(edges), F.col(label).eqNullSafe(F.col("_class")), "left")
    edge = F.coalesce(F.col("_edge"), F.lit(""))
    clear = placed.filter(F.col("_b") != edge).withColumn("is_train", F.col("_b") < edge)
    order = Window.partitionBy(label).orderBy("_h", *ids)
    ranked = placed.filter(F.col("_b") == edge).withColumn("is_train", F.row_number().over(order) <= F.col("_need"))
    return clear.unionByName(ranked).select(*df.columns, "is_train")


# Measures

def _by_score(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(s, p, n): positives and negatives of each distinct score."""
    return scored.groupBy(F.col(score).cast("double").alias("s")).agg(
        count_true(F.col(label) == 1).alias("p"), count_true(F.col(label) != 1).alias("n")
    )


def _area(per: DataFrame) -> DataFrame:
    """The negatives below a score are those of lower ranges of scores plus those before it in its own range. The ranges
    come from the scores, so scores crowded in one place are spread like any others."""
    parts = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(per.repartitionByRange(parts, "s").withColumn("range", F.spark_partition_id()), "scores")
    ranges = dealt.groupBy("range").agg(F.sum("n").alias("bn"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("range", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    ranked = dealt.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), "range")
    pairs = F.sum(F.col("p").cast("double") * (F.col("below") + F.col("within") + F.col("n") / 2.0))
    total = F.sum("p").cast("double") * F.sum("n").cast("double")
    return ranked.agg(F.coalesce(F.try_divide(pairs, total), F.lit(0.5)).alias("auc"))


def auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the curve, ties at half weight; 0.5 for a single class."""
    return _area(_by_score(scored, label, score))


def classifier_metrics(scored: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """Confusion cells, accuracy, precision, recall, F1 and AUC in one row, all from the counts per score."""
    # read by the cells, by the bounds of the ranges and by the ranges: rows are scored once
    per = written(_by_score(scored, label, score), "by-score")

    def total(column: str, on: Column) -> Column:
        return F.coalesce(F.sum(F.when(on, F.col(column))), F.lit(0))

    said = F.col("s") >= cut
    cells = per.agg(
        total("p", said).alias("tp"), total("n", ~said).alias("tn"), total("n", said).alias("fp"), total("p", ~said).alias("fn")
    )
    return measures(cells).withColumn("auc", round_to(_area(per).scalar(), 4))


def overfit_alert(metrics: DataFrame) -> DataFrame:
    perfect = (F.col("accuracy") >= PERFECT) & (F.col("precision") >= PERFECT) & (F.col("recall") >= PERFECT)
    return metrics.withColumn("alert", perfect)


# Training

def fit_codes(df: DataFrame, categorical: list[str]) -> dict[str, DataFrame]:
    """Code table per column, kept as tables: the values of a column may be too many for the driver."""
    return {c: written(label_table(df, c), "codes") for c in categorical}


def numeric_stages(categorical: list[str], numeric: list[str]) -> tuple[list, list[str]]:
    """Stages from coded columns and raw numbers to the feature vector; what is no number becomes 0."""
    names = [f"{c}_encoded" for c in categorical] + list(numeric)
    filled = ", ".join(f"coalesce(try_cast(`{c}` AS double), 0D) AS `{c}__num`" for c in names)
    fill = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    return [fill, VectorAssembler(inputCols=[f"{c}__num" for c in names], outputCol="features")], names


def _transform(trained: Trained, df: DataFrame) -> DataFrame:
    return trained.model.transform(encode_labels(df, list(trained.codes), trained.codes))


def _levels(rows: DataFrame, column: str) -> list[float]:
    """``BINS`` values of a column that has more: quantiles of its rows, then of the rows whose value is none of them yet."""
    found: set[float] = set()
    while len(found) < BINS:
        rest, n = rows.filter(~F.col(column).isin(*found)) if found else rows, BINS - len(found)
        more = {v for v in rest.approxQuantile(column, [(i + 0.5) / n for i in range(n)], 0.001) if math.isfinite(v)}
        if not more - found:
            break
        found |= more
    return sorted(found)


def _many_valued(rows: DataFrame, columns: list[str]) -> set[str]:
    """Columns of more than ``BINS`` values; a task stops looking at a column once it has seen as many."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Array] = [pa.array([], pa.float64())] * len(columns)
        for batch in batches:
            for i, values in enumerate(batch.columns):
                if len(seen[i]) <= BINS:
                    seen[i] = pc.unique(pa.concat_arrays([seen[i], pc.unique(values)]))
        at = np.repeat(np.arange(len(columns), dtype=np.int32), [min(len(v), BINS + 1) for v in seen])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.concat_arrays([v[: BINS + 1] for v in seen])], names=["at", "value"])

    # at most BINS + 1 values of each column and task
    found = rows.select(*columns).mapInArrow(look, "at int, value double").groupBy("at").agg(F.countDistinct("value").alias("n"))
    return {columns[r["at"]] for r in found.filter(F.col("n") > BINS).collect()}


def merge_rows(coded: DataFrame, stages: list, names: list[str], label: str, mean: bool) -> DataFrame | None:
    """(features, label, weight): training rows that trees cannot tell apart as one row with their number; None where that saves little.

    Every row counts. A feature of more than ``BINS`` values takes the nearest of ``BINS`` quantiles; MLlib's splits are the
    midpoints of these, so a value falls on the side of a split that its quantile falls on. With ``mean`` the label is the mean of the merged rows, as
    what labels differ by inside a merged row does not bear on a gain; without it only rows of one label are merged.
    """
    fill, assemble = stages
    numbers = [f"{n}__num" for n in names]
    # a missing label stays an error of the fit
    y = F.coalesce(F.col(label).cast("double"), F.lit(math.nan)) if mean else F.col(label)
    rows = written(fill.transform(coded).select(*numbers, y.alias(label)), "numbers")
    many = _many_valued(rows, numbers)
    merged = rows
    for c in numbers:
        levels = _levels(rows, c) if c in many else []
        if len(levels) > 1:
            # a value on a midpoint goes left in a tree
            cuts = [math.nextafter((a + b) / 2, math.inf) for a, b in zip(levels, levels[1:])]
            placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=c, outputCol="_level").transform(merged)
            merged = placed.withColumn(c, F.element_at(F.lit(levels), F.col("_level").cast("int") + 1)).drop("_level")
    n = F.count("*").cast("double").alias("weight")
    groups = merged.groupBy(*numbers).agg(F.avg(label).alias(label), n) if mean else merged.groupBy(*numbers, label).agg(n)
    # few rows that are heavy to fit: dealt over the cores
    groups = written(groups.repartition(rows.sparkSession.sparkContext.defaultParallelism), "merged")
    count, total = groups.agg(F.count("*"), F.sum("weight")).first()
    return assemble.transform(groups).select("features", label, "weight") if count * MERGED_ROWS <= (total or 0) else None


def _classifier(algorithm: str, seed: int, trees: int, merged: DataFrame | None = None, memory: int = TREE_MEMORY_MB):
    if algorithm == "gradient_boosting":
        chosen = GBTClassifier(
            labelCol="label", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=seed, maxMemoryInMB=TREE_MEMORY_MB
        )
        return chosen if merged is None else chosen.setWeightCol("weight")
    chosen = RandomForestClassifier(
        labelCol="label", numTrees=trees, maxDepth=8, minInstancesPerNode=MIN_LEAF_ROWS,
        featureSubsetStrategy="sqrt", subsamplingRate=0.8, seed=seed, maxMemoryInMB=memory,
    )
    if merged is None:
        return chosen
    # a leaf holds as many rows as ever, which may be one merged row
    share = min(0.49, MIN_LEAF_ROWS / merged.agg(F.sum("weight")).first()[0])
    return chosen.setWeightCol("weight").setMinInstancesPerNode(1).setMinWeightFractionPerNode(share)


def train_classifier(
    df: DataFrame, target: str, ids: list[str], algorithm: str = "random_forest",
    categorical: list[str] | None = None, numeric: list[str] | None = None, seed: int = SEED, trees: int = TREES,
) -> Trained:
    """Split 80/20 by class, fit on all training rows, measure on the rest."""
    if categorical is None and numeric is None:
        categorical, numeric = select_features(df, target)
    categorical, numeric = categorical or [], numeric or []
    # read by the split, the codes, the merging and the measures: whatever makes the rows runs once for them
    kept = written(df.select(*dict.fromkeys([*ids, target, *categorical, *numeric])), "rows")
    rows = binary_target(kept, target).select(*ids, "label", target, *categorical, *numeric)
    if rows.limit(MIN_CLASSIFIER_ROWS).count() < MIN_CLASSIFIER_ROWS:
        raise ValueError(f"need at least {MIN_CLASSIFIER_ROWS} rows")
    codes = fit_codes(rows, categorical)
    split = written(split_stratified(rows, ids, "label", TRAIN_SHARE, seed), "split")
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    stages, features = numeric_stages(categorical, numeric)
    merged = merge_rows(encode_labels(train, categorical, codes), stages, features, "label", mean=False)
    memory = TREE_MEMORY_MB
    if merged is None:
        if train.count() > FEW_ROWS:
            memory = CACHED_MB
        else:
            # a fit of single rows draws by their place, so few rows are taken as they come and not from the files
            plain = binary_target(df, target).select(*ids, "label", target, *categorical, *numeric)
            train = split_stratified(plain, ids, "label", TRAIN_SHARE, seed).filter("is_train")
        prepared = PipelineModel(stages).transform(encode_labels(train, categorical, codes)).select("features", "label")
    else:
        prepared = merged
    fitted = _classifier(algorithm, seed, trees, merged, memory).fit(prepared)
    model = PipelineModel(stages + [fitted])
    scored = score_batch(Trained(model, features, target, None, codes), test, ids)
    metrics = overfit_alert(classifier_metrics(scored, "actual", "probability")).withColumns({
        "algorithm": F.lit(algorithm), "features_used": F.lit(len(features)), "target": F.lit(target),
    })
    # one row, computed here once
    return Trained(model, features, target, written(metrics, "metrics"), codes)


def _probability(transformed: DataFrame) -> Column:
    return clip(vector_to_array(transformed["probability"])[1], 0.0, 1.0)


def score_batch(trained: Trained, df: DataFrame, ids: list[str]) -> DataFrame:
    """Every row scored: probability, predicted, the row's own outcome, risk level; order is the caller's."""
    out = _transform(trained, df)
    p = _probability(out)
    actual = target_flag(out, trained.target, POSITIVE_TARGETS).cast("int") if trained.target in out.columns else F.lit(None).cast("int")
    return out.select(
        *ids, p.alias("probability"), (out["prediction"] == 1.0).alias("predicted"),
        actual.alias("actual"), risk_level(p).alias("risk_level"),
    )


def score_rows(trained: Trained, df: DataFrame, ids: list[str]) -> DataFrame:
    """Scores for new rows: missing inputs count as unknown or 0, probability to 3 places, advice text."""
    from pyspark.sql import types as T

    kinds = {f.name: f.dataType for f in df.schema}
    missing = [f.removesuffix("_encoded") for f in trained.features if f.removesuffix("_encoded") not in kinds]
    padded = df.withColumns({c: F.lit(None).cast(T.StringType()) for c in missing}) if missing else df
    out = _transform(trained, padded)
    p = _probability(out)
    level = risk_level(p)
    return out.select(
        *ids, (out["prediction"] == 1.0).alias("positive"), round_to(p, 3).alias("probability"),
        level.alias("risk_level"), recommendation(level).alias("recommendation"),
    )


def rank_predictions(scored: DataFrame, ids: list[str]) -> DataFrame:
    return scored.orderBy(F.desc("probability"), *ids)


def feature_importance(trained: Trained) -> DataFrame:
    """(feature, importance); one row per model input."""
    values = trained.model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(trained.features, values)]
    return _session(trained).createDataFrame(rows, "feature string, importance double")


def rank_importance(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def _session(trained: Trained):
    from pyspark.sql import SparkSession

    return trained.metrics.sparkSession if trained.metrics is not None else SparkSession.getActiveSession()


def save_model(trained: Trained, path: str) -> None:
    """Pipeline, code tables and a one-row description below ``path``."""
    trained.model.write().overwrite().save(f"{path}/pipeline")
    about = [(trained.target, json.dumps(trained.features))]
    spark = _session(trained)
    spark.createDataFrame(about, "target string, features string").write.mode("overwrite").json(f"{path}/about")
    for column, codes in trained.codes.items():
        codes.write.mode("overwrite").parquet(f"{path}/codes/{column}")
    if trained.metrics is not None:
        trained.metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_model(spark, path: str) -> Trained:
    about = spark.read.schema("target string, features string").json(f"{path}/about").first()
    features = json.loads(about["features"])
    coded = [f.removesuffix("_encoded") for f in features if f.endswith("_encoded")]
    return Trained(
        PipelineModel.load(f"{path}/pipeline"), features, about["target"], spark.read.parquet(f"{path}/metrics"),
        {c: spark.read.parquet(f"{path}/codes/{c}") for c in coded},
    )


# Rate regression

def train_rate_regressor(
    df: DataFrame, ids: list[str], value: str, categorical: list[str], numeric: list[str], seed: int = SEED, trees: int = TREES
) -> Trained:
    """Forest regression of a rate on coded attributes; metrics hold both R2 values and the entity counts."""
    rows = df.select(*ids, value, *categorical, *numeric)
    if rows.limit(MIN_REGRESSOR_ROWS).count() < MIN_REGRESSOR_ROWS:
        raise ValueError(f"need at least {MIN_REGRESSOR_ROWS} rows")
    codes = fit_codes(rows, categorical)
    split = split_stratified(rows.withColumn("_all", F.lit(1)), ids, "_all", TRAIN_SHARE, seed)
    coded = encode_labels(split, categorical, codes)
    stages, features = numeric_stages(categorical, numeric)
    forest = RandomForestRegressor(labelCol=value, numTrees=trees, maxDepth=10, seed=seed, maxMemoryInMB=TREE_MEMORY_MB)
    train = coded.filter("is_train")
    merged = merge_rows(train, stages, features, value, mean=True)
    if merged is None:
        fitted = forest.fit(PipelineModel(stages).transform(train).select("features", value))
    else:
        fitted = forest.setWeightCol("weight").fit(merged)
    model = PipelineModel(stages + [fitted])
    scored = model.transform(coded).select("is_train", value, "prediction", *categorical)

    def r2(on: Column) -> Column:
        y = F.when(on, F.col(value))
        gap = F.when(on, F.col(value) - F.col("prediction"))
        return round_to(1 - F.try_divide(F.sum(gap * gap), F.var_pop(y) * F.count(y)), 4)

    metrics = scored.agg(
        F.count("*").alias("total_records"), count_true(F.col("is_train")).alias("train_records"),
        count_true(~F.col("is_train")).alias("test_records"),
        r2(F.col("is_train")).alias("train_r2"), r2(~F.col("is_train")).alias("test_r2"),
        *[F.countDistinct(c).alias(f"unique_{c}") for c in categorical[:2]],
    )
    return Trained(model, features, value, written(metrics, "metrics"), codes)


def score_rate(trained: Trained, df: DataFrame, keep: list[str]) -> DataFrame:
    return _transform(trained, df).select(*keep, round_to(F.col("prediction"), 2).alias("predicted_rate"))


def rate_gap(trained: Trained, combos: DataFrame, keys: list[str], actual: str) -> DataFrame:
    """Actual mean, predicted rate and their difference per key combination."""
    scored = _transform(trained, combos)
    predicted = round_to(F.col("prediction"), 2)
    return scored.select(
        *keys, round_to(F.col(actual), 2).alias("actual_rate"), predicted.alias("predicted_rate"),
        round_to(predicted - F.col(actual), 2).alias("difference"),
    )
