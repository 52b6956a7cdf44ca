"""Time-series features per entity.

No window here is partitioned by the entity alone. Rows get their position inside the entity from
counts per range of rows, and windows run on fixed blocks of positions that carry the few rows of the
block before them. An entity that holds a third of the table is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import round_to
from brindle.functions.text import grouped
from brindle.session import written

BLOCK_ROWS = 100_000
VOLATILE_CV, STABLE_SLOPE, MIN_TREND_ROWS = 0.5, 0.01, 5
MIN_CHANGE_ROWS, CHANGE_WINDOW, CHANGE_Z = 10, 5, 2.0


def _null_safe(keys: Sequence[str], renamed: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on keys that may be null; the right side's keys are dropped."""
    renamed = {k: f"_r_{k}" for k in keys}
    other = right.withColumnsRenamed(renamed)
    return left.join(other, _null_safe(keys, renamed), how).drop(*renamed.values())


def with_position(df: DataFrame, entity: Sequence[str], order: Sequence[Column], out: str = "pos") -> DataFrame:
    """Adds the 0-based row number inside the entity.

    Rows are dealt into ranges of (entity, order), whose bounds come from a sample of the rows themselves, so a range holds about
    the same number of rows whatever one entity or one stretch of time holds. They are numbered inside a range and shifted by
    the rows of the same entity in earlier ranges. The dealt rows are written once, as the number of a range must not change. Null
    entities count as an entity.
    """
    name = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in entity], F.lit(""))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_entity", name).repartitionByRange(parts, F.asc("_entity"), *order)
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_entity", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_entity").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_entity", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_entity", "_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_local", local).join(offsets, ["_entity", "_range"])
    return placed.select(*df.columns, (F.col("_before") + F.col("_local")).alias(out))


def by_time(df: DataFrame, entity: Sequence[str], ts: str, ties: Sequence[str] = (), out: str = "pos") -> DataFrame:
    """Positions in time order, rows without a time last."""
    return with_position(df, entity, [F.asc_nulls_last(ts), *[F.asc(c) for c in ties]], out)


def blocks(df: DataFrame, reach: int, pos: str = "pos", size: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``_block``; the last ``reach`` rows of a block also appear, marked ``_carried``, in the next."""
    own = F.floor(F.col(pos) / size)
    late = F.col(pos) % size >= size - reach
    homes = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(homes)).withColumn("_carried", F.col("_block") > own)


def _window(entity: Sequence[str], pos: str = "pos"):
    return Window.partitionBy(*entity, "_block").orderBy(pos)


def _settle(df: DataFrame) -> DataFrame:
    return df.filter("NOT _carried").drop("_block", "_carried")


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Nine calendar columns; Monday is day 0."""
    d = F.col(ts).cast("date")
    return df.withColumns({
        "day_of_week": F.weekday(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "day_of_month": F.dayofmonth(d),
        "week_of_year": F.weekofyear(d),
        "is_weekend": F.weekday(d).isin(5, 6).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
    })


def seq_index(df: DataFrame, entity: Sequence[str], order: Sequence[Column], start: str = "2026-01-01") -> DataFrame:
    """A daily date for rows without a time column, counted in row order."""
    placed = with_position(df, entity, order, "_p")
    return placed.withColumn("date_index", F.date_add(F.lit(start).cast("date"), F.col("_p").cast("int"))).drop("_p")


def lag_features(
    df: DataFrame, entity: Sequence[str], ts: str, value: str, lags: Sequence[int] = (1, 7, 30),
    ties: Sequence[str] = (), block: int = BLOCK_ROWS,
) -> DataFrame:
    placed = blocks(by_time(df, entity, ts, ties), max(lags), size=block)
    w = _window(entity)
    return _settle(placed.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags}))


def rolling_features(
    df: DataFrame, entity: Sequence[str], ts: str, value: str, means: Sequence[int] = (7, 30),
    stds: Sequence[int] = (7,), ties: Sequence[str] = (), block: int = BLOCK_ROWS,
) -> DataFrame:
    """Trailing means and sample deviations over row counts; shorter frames at the start."""
    placed = blocks(by_time(df, entity, ts, ties), max([*means, *stds]), size=block)
    w = _window(entity)
    out = {f"rolling_mean_{k}": F.avg(value).over(w.rowsBetween(1 - k, 0)) for k in means}
    out.update({f"rolling_std_{k}": F.stddev_samp(value).over(w.rowsBetween(1 - k, 0)) for k in stds})
    return _settle(placed.withColumns(out))


def pct_change(
    df: DataFrame, entity: Sequence[str], ts: str, value: str, ties: Sequence[str] = (),
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Change against the row before, nulls taken from the last known value; NULL after a zero."""
    placed = blocks(by_time(df, entity, ts, ties), 1, size=block)
    # last known value of each block, carried over blocks that hold none
    own = placed.filter("NOT _carried").groupBy(*entity, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("pos"))).alias("_known")
    )
    before = Window.partitionBy(*entity).orderBy("_block")
    # the carried row sits at the start of the block, so the seed is what was known before that row's own block
    seeds = own.select(
        *entity, "_block",
        F.last("_known", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_seed"),
    )
    seeded = join_null_safe(placed, seeds, [*entity, "_block"])
    w = _window(entity)
    filled = F.coalesce(
        F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_seed")
    )
    known = seeded.withColumn("_filled", filled)
    previous = F.lag("_filled", 1).over(w)
    out = known.withColumn("pct_change", F.try_divide(F.col("_filled"), previous) - 1)
    return _settle(out.drop("_filled", "_seed"))


def trend_fit(
    df: DataFrame, entity: Sequence[str], ts: str, value: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Per entity: line through (0..n-1, value), its R2, variation, direction and strength."""
    known, missing = df.filter(F.col(value).isNotNull()), df.filter(F.col(value).isNull())
    placed = by_time(known, entity, ts, ties).unionByName(missing.withColumn("pos", F.lit(None).cast("bigint")))
    y, x = F.col(value).cast("double"), F.col("pos").cast("double")
    fitted = placed.groupBy(*entity).agg(
        F.count("*").alias("_all"), F.count(value).alias("n"), F.regr_slope(y, x).alias("_slope"),
        F.regr_r2(y, x).alias("_r2"), F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_sd"),
    )
    short = F.col("_all") < MIN_TREND_ROWS
    relative = F.coalesce(F.try_divide(F.col("_slope"), F.col("_mean")), F.lit(0.0))
    cv = F.coalesce(F.try_divide(F.col("_sd"), F.col("_mean")), F.lit(0.0))
    direction = (
        F.when(short, "unknown").when(cv > VOLATILE_CV, "volatile")
        .when(F.abs(relative) < STABLE_SLOPE, "stable").when(relative > 0, "increasing").otherwise("decreasing")
    )
    strength = (
        F.when(short, 0.0).when(cv > VOLATILE_CV, F.least(cv, F.lit(1.0)))
        .when(F.abs(relative) < STABLE_SLOPE, 1 - F.abs(relative) * 10)
        .otherwise(F.least(F.abs(relative) * 10, F.lit(1.0)))
    )
    return fitted.select(
        *entity, "n",
        F.when(short, 0.0).otherwise(F.coalesce("_slope", F.lit(0.0))).alias("slope"),
        F.when(short, 0.0).otherwise(F.coalesce("_r2", F.lit(0.0))).alias("r2"),
        F.when(short, 0.0).otherwise(cv).alias("cv"), direction.alias("direction"), strength.alias("strength"),
    )


def trend_summary(fit: DataFrame) -> DataFrame:
    """Adds one sentence per fitted trend."""
    lead = F.concat(F.lit("Based on "), F.col("n").cast("string"), F.lit(" data points, the trend is "), F.col("direction"))
    sloped = F.concat(
        F.lit(" with "), F.round((F.col("strength") * 100).cast("decimal(38,8)"), 0).cast("bigint").cast("string"),
        F.lit("% confidence. R² fit: "), grouped(F.col("r2"), 3),
        F.lit(". Slope: "), F.replace(grouped(F.col("slope"), 4), F.lit(","), F.lit("")), F.lit(" per period"),
    )
    text = (
        F.when(F.col("direction") == "unknown", "Insufficient data for trend analysis (minimum 5 points required)")
        .when(F.col("direction").isin("increasing", "decreasing"), F.concat(lead, sloped))
        .when(F.col("direction") == "volatile", F.concat(lead, F.lit(". High variability detected (CV > 50%)")))
        .otherwise(lead)
    )
    return fit.withColumn("summary", text)


def change_points(
    df: DataFrame, entity: Sequence[str], ts: str, value: str, z: float = CHANGE_Z,
    exclude_current: bool = True, ties: Sequence[str] = (), block: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows further than ``z`` deviations from the rows before them.

    ``exclude_current=False`` keeps the row inside its own frame. A frame of at most five rows then
    bounds the distance at 1.79, so nothing passes the default of 2.
    """
    rows = df.filter(F.col(value).isNotNull())
    placed = by_time(rows, entity, ts, ties)
    sizes = placed.groupBy(*entity).agg(F.count("*").alias("_n"))
    sized = join_null_safe(placed, sizes.filter(F.col("_n") >= MIN_CHANGE_ROWS), list(entity), "inner")
    windowed = sized.withColumn("_w", F.least(F.lit(CHANGE_WINDOW), F.floor(F.col("_n") / 3)).cast("int"))
    framed = blocks(windowed, CHANGE_WINDOW, size=block)
    w = _window(entity)

    def over(fn, k):
        frame = w.rowsBetween(-k, -1) if exclude_current else w.rowsBetween(1 - k, 0)
        return fn(value).over(frame)

    # ten rows or more give a window of three, four or five
    mean = F.when(F.col("_w") == 3, over(F.avg, 3)).when(F.col("_w") == 4, over(F.avg, 4)).otherwise(over(F.avg, 5))
    sd = F.when(F.col("_w") == 3, over(F.stddev_samp, 3)).when(F.col("_w") == 4, over(F.stddev_samp, 4)).otherwise(over(F.stddev_samp, 5))
    judged = _settle(framed.withColumns({"_mean": mean, "_sd": sd}))
    score = F.try_divide(F.abs(F.col(value) - F.col("_mean")), F.col("_sd"))
    hit = (F.col("pos") >= F.col("_w")) & (F.col("pos") < F.col("_n") - 1) & (F.col("_sd") > 0) & (score > z)
    return judged.filter(hit).select(*entity, ts, value, "pos", round_to(score, 4).alias("z"))
