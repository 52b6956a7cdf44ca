"""Z-score, interquartile and isolation-forest detection."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import round_to, severity_forest, severity_z
from brindle.operators.quantiles import exact_quantiles
from brindle.session import written

Z_LIMIT, FENCE = 3.0, 1.5
TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.1, 42


def zscores(df: DataFrame, ids: list[str], columns: list[str], limit: float = Z_LIMIT) -> DataFrame:
    """(ids, position, column, value, score) for every value beyond the limit; constant columns give none.

    The column means and deviations are one row, read as a scalar; no row is joined or shuffled.
    """
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns
    ])).scalar()
    held = df.select(*ids, *columns).withColumn("_stats", stats)
    hits = F.filter(
        F.array(*[
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                F.abs(F.try_divide(F.col(c) - F.col("_stats")[c]["m"], F.col("_stats")[c]["s"])).alias("score"),
            )
            for i, c in enumerate(columns)
        ]),
        lambda h: h["score"] > limit,
    )
    return held.select(*ids, F.inline(hits))


def dedup_first(hits: DataFrame, ids: list[str]) -> DataFrame:
    """One hit per row, the one of the earliest column."""
    order = Window.partitionBy(*ids).orderBy("position")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def anomaly_zscore(df: DataFrame, ids: list[str], columns: list[str], limit: float = Z_LIMIT) -> DataFrame:
    """First offending column per row with score and severity."""
    first = dedup_first(zscores(df, ids, columns, limit), ids)
    return first.withColumn("severity", severity_z(F.col("score"))).drop("position")


def rank_anomalies(hits: DataFrame, ids: list[str]) -> DataFrame:
    return hits.orderBy(F.desc("score"), *ids)


def anomaly_iqr(df: DataFrame, ids: list[str], columns: list[str], fence: float = FENCE) -> DataFrame:
    """Values outside the quartile fences, first offending column per row."""
    quartiles = exact_quantiles(df, columns, (0.25, 0.75))
    parts = []
    for i, c in enumerate(columns):
        low, high = quartiles[c]
        if low is None:
            continue
        width = fence * (high - low)
        x = F.col(c).cast("double")
        beyond = F.greatest(F.lit(low - width) - x, x - F.lit(high + width))
        parts.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), x.alias("value"), beyond.alias("beyond")))
    hits = F.filter(F.array(*parts), lambda h: h["beyond"] > 0)
    # the array is in column order, so its first entry is the first offending column
    return df.select(*ids, F.get(hits, F.lit(0)).alias("h")).filter("h IS NOT NULL").select(*ids, "h.column", "h.value", "h.beyond")


def anomaly_report(hits: DataFrame, total: Column, method: str, severity: str = "severity") -> DataFrame:
    """Count, share and sentence; ``total`` is a scalar."""
    counted = hits.agg(
        F.count("*").alias("anomalies"), F.count_if(F.col(severity) == "high").alias("high"),
    ).withColumn("total", total)
    pct = F.try_divide(F.col("anomalies").cast("double") * 100, F.col("total").cast("double"))
    return counted.select(
        "anomalies", "high", "total", round_to(pct, 1).alias("percent"), F.lit(method).alias("method"),
        F.concat(
            F.lit("Found "), F.col("anomalies").cast("string"), F.lit(" anomalies ("), F.format_number(round_to(pct, 1), 1),
            F.lit(f"%) using {method}"),
        ).alias("summary"),
    )


# Isolation forest

TREE = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, length array<double>"

def _path_constant(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def _grow(points: np.ndarray, seed: int) -> dict[str, list]:
    """One isolation tree as parallel node arrays; a leaf has feature -1 and its depth plus the constant."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "length": []}
    waiting = [(np.arange(len(points)), 0, None)]
    while waiting:
        rows, depth, parent = waiting.pop()
        me = len(nodes["feature"])
        if parent is not None:
            nodes[parent[1]][parent[0]] = me
        low, high = points[rows].min(0), points[rows].max(0)
        splittable = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or not len(splittable)
        feature = -1 if leaf else int(rng.choice(splittable))
        cut = 0.0 if leaf else float(rng.uniform(low[feature], high[feature]))
        nodes["feature"].append(feature)
        nodes["threshold"].append(cut)
        nodes["left"].append(-1)
        nodes["right"].append(-1)
        nodes["length"].append(float(depth + _path_constant(len(rows))) if leaf else 0.0)
        if not leaf:
            below = points[rows, feature] < cut
            waiting += [(rows[below], depth + 1, (me, "left")), (rows[~below], depth + 1, (me, "right"))]
    return nodes


def fit_forest(df: DataFrame, ids: list[str], columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> list[dict]:
    """Trees grown in parallel, each on its own hash sample of ``sample`` rows.

    A pool of ``trees * sample`` rows is drawn by hash order, then every tree takes its rows from the
    pool by another hash. The pool and the trees are bounded by the two parameters.
    """
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ids])
    pool = df.select(key.alias("_k"), *[F.col(c).cast("double").alias(c) for c in columns])
    pool = pool.orderBy(F.xxhash64(F.lit(seed), "_k"), "_k").limit(trees * sample)
    # positions in the pool, dealt in runs of one sample per tree and from the start again when used up
    everything = Window.partitionBy(F.lit(0))
    placed = pool.withColumns({
        "_p": F.row_number().over(everything.orderBy(F.xxhash64(F.lit(seed), "_k"), "_k")) - 1, "_m": F.count("*").over(everything),
    })
    each = F.least(F.lit(sample), F.col("_m"))
    turns = F.sequence(F.col("_p"), trees * each - 1, F.col("_m"))
    drawn = placed.filter(F.col("_p") < trees * each).withColumn("_turn", F.explode(turns)).withColumn(
        "tree", F.floor(F.col("_turn") / each).cast("int")
    )

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("_k")[columns].to_numpy()
        return pd.DataFrame({"tree": [key[0]], **{k: [v] for k, v in _grow(ordered, seed + key[0]).items()}})

    grown = drawn.groupBy("tree").applyInPandas(
        grow, TREE
    )
    return [r.asDict() for r in grown.orderBy("tree").collect()]


def forest_score(trees: list[dict], columns: list[str], sample: int) -> Column:
    """Negative isolation score in (-1, 0); lower is stranger."""
    packed = [{k: np.asarray(t[k]) for k in ("feature", "threshold", "left", "right", "length")} for t in trees]
    scale = float(_path_constant(sample))

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        points = np.column_stack([v.to_numpy(dtype=float) for v in values])
        depth = np.zeros(len(points))
        for t in packed:
            at = np.zeros(len(points), dtype=int)
            while True:
                feature = t["feature"][at]
                inner = np.flatnonzero(feature >= 0)
                if not len(inner):
                    break
                here = at[inner]
                below = points[inner, feature[inner]] < t["threshold"][here]
                at[inner] = np.where(below, t["left"][here], t["right"][here])
            depth += t["length"][at]
        return pd.Series(-np.power(2.0, -depth / (len(packed) * scale)))

    return score(*[F.col(c).cast("double") for c in columns])


@dataclass(frozen=True)
class Forest:
    """A fitted forest: its trees, the columns with the values that stand for missing ones, and the cut of the scores."""

    trees: list[dict]
    columns: list[str]
    fills: list[float]
    sample: int
    offset: float


def _filled(df: DataFrame, ids: list[str], columns: list[str], fills: list[float]) -> DataFrame:
    return df.select(*ids, *[F.coalesce(F.col(c).cast("double"), F.lit(x)).alias(c) for c, x in zip(columns, fills)])


def _judged(raw: DataFrame, ids: list[str], offset: float) -> DataFrame:
    shifted = raw.withColumn("score", F.col("_raw") - F.lit(offset))
    return shifted.select(*ids, "score", (F.col("score") < 0).alias("anomaly"))


def fit_scores(
    df: DataFrame, ids: list[str], columns: list[str], share: float = CONTAMINATION, seed: int = SEED
) -> tuple[Forest, DataFrame]:
    """The forest and every row's (ids, score, anomaly); the cut is the exact ``share`` quantile of the scores."""
    medians = exact_quantiles(df, columns, (0.5,))
    fills = [medians[c][0] or 0.0 for c in columns]
    filled = _filled(df, ids, columns, fills)
    size = min(SAMPLE, filled.limit(SAMPLE).count())
    trees = fit_forest(filled, ids, columns, seed=seed)
    # scored once: the cut and the result both read the written scores
    raw = written(filled.select(*ids, forest_score(trees, columns, size).alias("_raw")), "scores")
    offset = exact_quantiles(raw, ["_raw"], (share,))["_raw"][0] or 0.0
    return Forest(trees, list(columns), fills, size, offset), _judged(raw, ids, offset)


def forest_scores(df: DataFrame, ids: list[str], columns: list[str], share: float = CONTAMINATION, seed: int = SEED) -> DataFrame:
    """Every row's (ids, score, anomaly); score is shifted so that the strangest ``share`` is below 0."""
    return fit_scores(df, ids, columns, share, seed)[1]


def score_with(forest: Forest, df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, score, anomaly) by a forest fitted before."""
    filled = _filled(df, ids, forest.columns, forest.fills)
    return _judged(filled.select(*ids, forest_score(forest.trees, forest.columns, forest.sample).alias("_raw")), ids, forest.offset)


ABOUT = "columns array<string>, fills array<double>, sample int, offset double"


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """One row per tree and one about the forest, below ``path``."""
    names = [part.split()[0] for part in TREE.split(", ")]
    spark.createDataFrame([tuple(t[n] for n in names) for t in forest.trees], TREE).write.parquet(f"{path}/trees")
    about = [(forest.columns, [float(x) for x in forest.fills], int(forest.sample), float(forest.offset))]
    spark.createDataFrame(about, ABOUT).write.parquet(f"{path}/about")


def load_forest(spark: SparkSession, path: str) -> Forest:
    about = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
    trees = [r.asDict() for r in spark.read.schema(TREE).parquet(f"{path}/trees").orderBy("tree").collect()]
    return Forest(trees, about["columns"], about["fills"], about["sample"], about["offset"])


def anomaly_iforest(df: DataFrame, ids: list[str], columns: list[str], share: float = CONTAMINATION, seed: int = SEED) -> DataFrame:
    """Rows called anomalous, with the size of the score and the severity."""
    found = forest_scores(df, ids, columns, share, seed).filter("anomaly")
    return found.select(*ids, F.abs("score").alias("score"), severity_forest(F.col("score")).alias("severity"))
