"""Names, types, roles, profiling, imputation and row descriptions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.numbers import round_to
from brindle.functions.text import label_of, strip
from brindle.operators.quantiles import exact_quantiles

# Words that may not be column names as they are.
RESERVED_COLUMNS = frozenset((
    "count", "order", "group", "select", "from", "where", "join", "left", "right", "inner", "outer", "on", "and",
    "or", "not", "null", "true", "false", "like", "in", "between", "case", "when", "then", "else", "end", "as",
    "by", "having", "limit", "offset", "union", "all", "distinct", "index", "key", "primary", "foreign",
    "references", "table", "column", "create", "drop", "alter", "insert", "update", "delete", "values",
))
RESERVED_IDENTIFIERS = frozenset((
    "add", "all", "alter", "and", "any", "as", "asc", "between", "by", "case", "check", "column", "constraint",
    "create", "cross", "current", "database", "default", "delete", "desc", "distinct", "drop", "else", "end",
    "exists", "false", "for", "foreign", "from", "full", "grant", "group", "having", "if", "in", "index", "inner",
    "insert", "into", "is", "join", "key", "left", "like", "limit", "not", "null", "offset", "on", "or", "order",
    "outer", "primary", "references", "revoke", "right", "select", "set", "table", "then", "to", "true", "union",
    "unique", "update", "values", "when", "where", "with",
))
MAX_IDENTIFIER = 128

# Fixed value: the share of values that must be numeric for a text column to count as one.
NUMERIC_SHARE = 0.8

# Date spellings, and name parts of identifiers and of target columns.
DATE_PATTERNS = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
)
TIME_STARTS = [*range(33), *map(ord, "+-T0123456789")]
IDENTIFIER_WORDS = ("id", "code", "number", "key", "ref", "uuid")
TARGET_WORDS = ("total", "count", "amount", "revenue", "sales", "cost", "price", "quantity", "volume")
CATEGORY_SHARE, CATEGORY_LIMIT = 0.5, 50

# Name parts that keep a column out of a model.
NOT_FEATURES = ("id", "customer", "employee", "user", "client", "date", "timestamp", "upload", "source", "file")
LEAKAGE = ("churn", "attrition", "cancelled", "churned", "left", "departed", "exited")


# Names

def normal_name(name: str) -> str:
    plain = re.sub(r"[ .-]", "_", name.lower().strip())
    return f"col_{plain}" if plain in RESERVED_COLUMNS else plain


def normalize_columns(df: DataFrame) -> DataFrame:
    """Plain lower-case names; a name that would repeat gets a numbered ending."""
    taken, names = set(), []
    for name in map(normal_name, df.columns):
        unique, n = name, 1
        while unique in taken:
            n += 1
            unique = f"{name}_{n}"
        taken.add(unique)
        names.append(unique)
    return df.toDF(*names)


def sanitize_identifier(name: Column) -> Column:
    """Safe identifier of a text column; NULL when empty or longer than 128 characters."""
    low = F.lower(strip(name))
    safe = F.regexp_replace(F.regexp_replace(low, "[^a-zA-Z0-9_]", "_"), "^[^a-zA-Z_]", "_")
    named = F.when(safe.isin(*sorted(RESERVED_IDENTIFIERS)), F.concat(F.lit("col_"), safe)).otherwise(safe)
    return F.when((low != "") & (F.length(low) <= MAX_IDENTIFIER), named)


# Types

# What a number may begin with: white space, a sign, a point or a digit; and the words that a cast reads as one.
NUMBER_STARTS = [*range(33), *map(ord, "+-."), *map(ord, "0123456789")]
NUMBER_WORDS = ("nan", "inf", "infinity")


def _numeric(text: Column) -> Column:
    """False only for texts that are no number: a look at the first letters costs far less than a cast that fails."""
    dated = (F.substring(text, 5, 1) == "-") & F.substring(text, 4, 1).between("0", "9")
    return ((text != "") & F.ascii(text).isin(NUMBER_STARTS) & ~dated & ~F.contains(text, F.lit(":"))) | F.lower(text).isin(*NUMBER_WORDS)


def number_of(text: Column) -> Column:
    trimmed = F.trim(text.cast("string"))
    return F.when(_numeric(trimmed), trimmed.try_cast("double"))


def leading_values(df: DataFrame, columns: list[str], order: str, count: int) -> DataFrame:
    """(column, place, value): the first non-null values of each column by row order.

    The rank limit is applied on each input partition first, so at most ``count`` rows per column
    and partition are shuffled.
    """
    tall = (
        df.select(F.col(order).alias("_order"), *[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot(["_order"], columns, "column", "value")
        .filter("value IS NOT NULL")
    )
    place = F.row_number().over(Window.partitionBy("column").orderBy("_order", "value"))
    return tall.withColumn("place", place).filter(F.col("place") <= count).select("column", "place", "value")


def infer_types(
    df: DataFrame, order: str | None = None, columns: list[str] | None = None,
    sample: int | None = None, share: float = NUMERIC_SHARE,
) -> DataFrame:
    """(column, type): typed columns keep their type, text columns are judged by all their values in one scan.

    ``sample`` judges by that many leading values in the order of ``order`` instead; values behind them may then not fit.
    """
    fixed, text = [], []
    for field in df.schema:
        if columns is not None and field.name not in columns:
            continue
        kind = declared_type(field.dataType)
        (text if kind is None else fixed).append((field.name, kind))
    spark = df.sparkSession
    known = spark.createDataFrame(fixed, "column string, type string")
    if not text:
        return known
    names = [name for name, _ in text]

    def judged(value: Column) -> list[Column]:
        x = number_of(value)
        # one value that is no number makes the column fractional
        whole = F.bool_and(F.when(value.isNotNull(), F.coalesce(x % 1 == 0, F.lit(False))))
        return [F.count(value).alias("n"), F.count(x).alias("numeric"), whole.alias("whole")]

    if sample is None:
        counts = df.agg(F.array(*[F.struct(F.lit(n).alias("column"), *judged(F.col(n))) for n in names]).alias("all")).select(F.inline("all"))
    else:
        asked = spark.createDataFrame([(n,) for n in names], "column string")
        counts = asked.join(leading_values(df, names, order, sample), "column", "left").groupBy("column").agg(*judged(F.col("value")))
    decided = F.when(F.col("numeric") > F.col("n") * share, F.when(F.col("whole"), "BIGINT").otherwise("DOUBLE"))
    return known.unionByName(counts.select("column", F.coalesce(decided, F.lit("STRING")).alias("type")))


def declared_type(kind: T.DataType) -> str | None:
    """Stored type of a typed column, None for text."""
    if isinstance(kind, T.IntegralType):
        return "BIGINT"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    return None


def type_map(types: DataFrame) -> dict[str, str]:
    """Driver-side map of the (column, type) table, one entry per column of the schema."""
    return {r["column"]: r["type"] for r in types.collect()}


def coerce(value: Column, kind: str) -> Column:
    """Cast to the stored type; what does not fit becomes NULL, whole numbers drop their fraction."""
    kind = kind.upper()
    if kind in ("BIGINT", "INT", "INTEGER"):
        # whole numbers are read as such: a double holds only those below 2^53 exactly
        text = F.trim(value.cast("string"))
        whole = F.when(_numeric(text) & ~F.contains(text, F.lit(".")), text.try_cast("bigint"))
        return F.coalesce(whole, F.nanvl(number_of(value), F.lit(None).cast("double")).try_cast("bigint"))
    if kind in ("DOUBLE", "FLOAT", "DECIMAL"):
        return F.nanvl(number_of(value), F.lit(None).cast("double"))
    if kind == "BOOLEAN":
        return value.try_cast("boolean")
    if kind == "TIMESTAMP":
        return value.try_cast("timestamp")
    return value.cast("string")


def coerce_values(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[coerce(F.col(c), types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def coerce_form(value: Column) -> Column:
    """struct(kind, number, text) of a form field: digits, digits with one dot, or text."""
    text = F.coalesce(value, F.lit(""))
    whole, real = text.rlike("^[0-9]+$"), text.rlike("^(?=.*[0-9])[0-9]*\\.?[0-9]*$")
    kind = F.when(whole, "int").when(real, "float").otherwise("text")
    return F.struct(
        kind.alias("kind"), F.when(kind != "text", text.try_cast("double")).alias("number"),
        F.when(kind == "text", text).alias("text"),
    )


# Billing rows and lineage

# Field aliases, length cuts and defaults of a billing row.
BILLING_ALIASES = {
    "enterprise_id": ("enterprise_id", "enterprise"),
    "subaccount": ("subaccount", "sub_account"),
    "device_type": ("device_type",),
    "service_type": ("service_type",),
    "monthly_rate": ("monthly_rate", "rate"),
    "bandwidth_mbps": ("bandwidth_mbps", "bandwidth"),
    "contract_start": ("contract_start",),
    "contract_end": ("contract_end",),
    "status": ("status",),
}
BILLING_CUTS = {"enterprise_id": 50, "subaccount": 50, "device_type": 50, "service_type": 50, "status": 20}
BILLING_DEFAULTS = {"contract_start": "2024-01-01", "contract_end": "2024-12-31", "status": "ACTIVE"}


def billing_defaults(df: DataFrame) -> DataFrame:
    """The nine billing fields from whatever aliases are present, numbers that fail become 0."""
    have = set(df.columns)

    def field(name: str) -> Column:
        sources = [F.col(a).cast("string") for a in BILLING_ALIASES[name] if a in have]
        return F.coalesce(*sources, F.lit(BILLING_DEFAULTS.get(name, "")))

    out = []
    for name in BILLING_ALIASES:
        value = field(name)
        if name == "monthly_rate":
            value = F.coalesce(number_of(value), F.lit(0.0))
        elif name == "bandwidth_mbps":
            value = F.coalesce(number_of(value).try_cast("int"), F.lit(0))
        elif name in BILLING_CUTS:
            value = F.substring(value, 1, BILLING_CUTS[name])
        out.append(value.alias(name))
    rest = [c for c in df.columns if not any(c in names for names in BILLING_ALIASES.values())]
    return df.select(*rest, *out)


def lineage_columns(df: DataFrame, source_file: Column, uploaded: Column | None = None, key: Column | None = None) -> DataFrame:
    """Adds id, upload_date, source_file and data_month."""
    when = uploaded if uploaded is not None else F.current_timestamp()
    return df.withColumns({
        "id": key if key is not None else F.expr("uuid()"),
        "upload_date": when,
        "source_file": source_file,
        "data_month": F.date_format(when, "yyyy-MM"),
    })


# Profile and roles

def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, metric, value): row count, nulls and, for numbers, mean, spread and range in one pass."""
    chosen = columns or df.columns
    aggs = []
    for c in chosen:
        aggs.append(F.count_if(F.col(c).isNull()).cast("double").alias(f"{c}\0missing"))
        aggs.append(round_to(100.0 * F.count_if(F.col(c).isNull()) / F.count("*"), 2).alias(f"{c}\0missing_pct"))
        if isinstance(df.schema[c].dataType, T.NumericType):
            aggs += [
                F.count(c).cast("double").alias(f"{c}\0count"),
                round_to(F.avg(c), 4).alias(f"{c}\0mean"),
                round_to(F.stddev_samp(c), 4).alias(f"{c}\0std"),
                F.min(c).cast("double").alias(f"{c}\0min"),
                F.max(c).cast("double").alias(f"{c}\0max"),
            ]
    wide = df.agg(*aggs)
    tall = wide.unpivot([], wide.columns, "_name", "value")
    parts = F.split("_name", "\0")
    return tall.select(parts[0].alias("column"), parts[1].alias("metric"), "value")


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, metric, value) for the exact 25, 50 and 75 % points."""
    probs = (0.25, 0.5, 0.75)
    found = exact_quantiles(df, columns, probs)
    rows = [(c, f"{int(p * 100)}%", v) for c in columns for p, v in zip(probs, found[c])]
    return df.sparkSession.createDataFrame(rows, "column string, metric string, value double")


def semantic_types(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, nulls, distinct_values) with kind identifier, numeric, timestamp, categorical or text.

    All values are looked at, in one pass of typed counts; distinct values are counted in the column's own type.
    """
    chosen = columns or [c for c in df.columns if c != order]

    kinds = {f.name: f.dataType for f in df.schema}

    def counted(place: int, column: str) -> Column:
        value = F.col(column)
        text = value.cast("string")
        if isinstance(kinds[column], T.NumericType):
            numbers, dated, dates = F.count(value), F.lit(False), F.lit(False)
        elif isinstance(kinds[column], (T.TimestampType, T.TimestampNTZType, T.DateType)):
            numbers, dated, dates = F.lit(0).cast("long"), F.count(value) > 0, F.count(value) > 0
        else:
            numbers = F.count(number_of(value))
            # no text without a digit is spelled as a date, but those with the name of a month; a time begins with a digit, a sign or T
            digits = reduce(lambda a, b: a | b, [text.rlike(p) for p in DATE_PATTERNS[:-1]])
            spelled = F.when(F.contains(text, F.lit("-")) | F.contains(text, F.lit("/")), digits).otherwise(F.lit(False)) | text.rlike("(?i)" + DATE_PATTERNS[-1])
            dated = F.bool_and(spelled)
            timed = F.when(F.ascii(text).isin(TIME_STARTS), text.try_cast("timestamp").isNotNull()).otherwise(F.lit(False))
            dates = F.bool_and(F.when(value.isNotNull(), timed))
        return F.struct(
            F.lit(column).alias("column"), F.lit(place).alias("position"), F.count("*").alias("rows"), F.count(value).alias("filled"),
            F.count_distinct(value).alias("distinct"), numbers.alias("numbers"), dated.alias("dated"), dates.alias("dates"),
        )

    stats = df.agg(F.array(*[counted(i, c) for i, c in enumerate(chosen)]).alias("all")).select(F.inline("all"))
    name = F.lower("column")
    named = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in IDENTIFIER_WORDS])
    few = (F.col("distinct") < F.col("rows") * CATEGORY_SHARE) & (F.col("distinct") < CATEGORY_LIMIT)
    kind = (
        F.when(named, "identifier")
        .when(F.col("numbers") == F.col("filled"), "numeric")
        .when(F.coalesce(F.col("dated"), F.lit(False)), "timestamp")
        .when(F.coalesce(F.col("dates"), F.lit(False)), "timestamp")
        .when(few, "categorical")
        .otherwise("text")
    )
    return stats.select(
        "column", "position", kind.alias("kind"), (F.col("rows") - F.col("filled")).alias("nulls"),
        F.col("distinct").alias("distinct_values"),
    )


def suggest_roles(kinds: DataFrame) -> DataFrame:
    """One row: the last numeric column named like a target (else the first numeric) and the first time column."""
    name = F.lower("column")
    wanted = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in TARGET_WORDS])
    numeric = F.col("kind") == "numeric"
    return kinds.agg(
        F.coalesce(
            F.max_by("column", F.when(numeric & wanted, F.col("position"))),
            F.min_by("column", F.when(numeric, F.col("position"))),
        ).alias("target"),
        F.min_by("column", F.when(F.col("kind") == "timestamp", F.col("position"))).alias("time_index"),
    )


def schema_score(kinds: DataFrame, df: DataFrame) -> DataFrame:
    """Share of columns whose detected kind fits the physical type; undetected kinds count one half."""
    def physical(kind: T.DataType) -> str:
        if isinstance(kind, T.NumericType):
            return "numeric"
        return "timestamp" if declared_type(kind) == "TIMESTAMP" else "categorical"

    pairs = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, physical(f.dataType))])
    actual = F.element_at(pairs, F.col("column"))
    point = (
        F.when(~F.col("kind").isin("numeric", "timestamp", "categorical"), 0.5)
        .when(F.col("kind") == actual, 1.0)
        .otherwise(0.0)
    )
    score = F.avg(point) * 100
    return kinds.agg(
        F.count("*").alias("columns_checked"), round_to(score, 2).alias("accuracy"), (score > 90).alias("meets_target")
    )


def select_features(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """(categorical, numeric) model inputs left after the name rules."""
    kept = [
        f for f in df.schema
        if f.name != target and not any(p in f.name.lower() for p in NOT_FEATURES + LEAKAGE)
    ]
    numeric = [f.name for f in kept if isinstance(f.dataType, T.NumericType)]
    return [f.name for f in kept if f.name not in numeric], numeric


# Imputation

def smallest_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest of equals; values are counted before columns are compared."""
    tall = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = tall.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    return {r["column"]: r["b"]["value"] for r in best.collect()}


def impute(df: DataFrame, numeric: list[str], timestamps: list[str] = (), categorical: list[str] = ()) -> DataFrame:
    """Drop empty rows, coerce, then fill numbers with the median and categories with the smallest mode."""
    typed = df.na.drop("all").withColumns({
        **{c: number_of(F.col(c)) for c in numeric},
        **{c: F.col(c).try_cast("timestamp") for c in timestamps},
    })
    medians = exact_quantiles(typed, list(numeric), (0.5,)) if numeric else {}
    fills = {c: F.coalesce(F.col(c), F.lit(medians[c][0])) for c in numeric}
    if categorical:
        modes = smallest_modes(typed, list(categorical))
        fills.update({c: F.coalesce(F.col(c), F.lit(modes[c])) for c in categorical if c in modes})
    return typed.withColumns(fills)


def row_to_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """``Title Case: value`` parts joined by ``. ``; lag and rolling columns and nulls are left out."""
    parts = []
    for f in df.schema:
        if f.name.startswith(("lag_", "rolling_")) or (columns is not None and f.name not in columns):
            continue
        value = F.col(f.name)
        if isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            shown = F.format_number(F.round(value.cast("decimal(38,8)"), 2), 2)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            shown = F.date_format(value, "MMMM dd, yyyy")
        else:
            shown = value.cast("string")
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{label_of(f.name)}: "), shown)))
    return F.concat_ws(". ", *parts)


