"""Table schemas, writers, retention and the vector index table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.vectors import norm, unit
from brindle.operators.schema import coerce_values, infer_types, normalize_columns, type_map

SQL_TYPES = {
    "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(), "STRING": T.StringType(),
}


def _field(name: str, kind: T.DataType, comment: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable, {"comment": comment})


CHUNK_SCHEMA = T.StructType([
    _field("id", T.StringType(), "Unique chunk id", False),
    _field("filename", T.StringType(), "Source file"),
    _field("text", T.StringType(), "Chunk text"),
    _field("embedding", T.ArrayType(T.FloatType()), "Vector of the text"),
    _field("chunk_index", T.IntegerType(), "Position in the document"),
    _field("upload_date", T.TimestampType(), "Time of upload"),
    _field("metadata", T.MapType(T.StringType(), T.StringType()), "Source and document id"),
])

BILLING_SCHEMA = T.StructType([
    _field("id", T.StringType(), "Unique record id", False),
    _field("enterprise_id", T.StringType(), "Enterprise"),
    _field("subaccount", T.StringType(), "Account inside the enterprise"),
    _field("device_type", T.StringType(), "Kind of device"),
    _field("service_type", T.StringType(), "Kind of service"),
    _field("monthly_rate", T.DecimalType(10, 2), "Rate per month"),
    _field("bandwidth_mbps", T.IntegerType(), "Bandwidth"),
    _field("contract_start", T.DateType(), "First day of the contract"),
    _field("contract_end", T.DateType(), "Last day of the contract"),
    _field("status", T.StringType(), "State of the contract"),
    _field("upload_date", T.TimestampType(), "Time of upload"),
    _field("data_month", T.StringType(), "Month of the data, yyyy-MM"),
])

LINEAGE = {"id": T.StringType(), "upload_date": T.TimestampType(), "source_file": T.StringType()}


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    try:
        return spark.read.parquet(path).schema
    except AnalysisException:
        return None


def create_table(df: DataFrame, path: str) -> T.StructType:
    """Schema of an existing table, else an empty table with normalised names and inferred types."""
    spark = df.sparkSession
    known = stored_schema(spark, path)
    if known is not None:
        return known
    named = normalize_columns(df)
    types = type_map(infer_types(named))
    fields = [T.StructField("id", T.StringType())] + [
        T.StructField(c, SQL_TYPES[types[c]]) for c in named.columns if c not in LINEAGE
    ] + [T.StructField(c, LINEAGE[c]) for c in ("upload_date", "source_file")]
    schema = T.StructType(fields)
    spark.createDataFrame([], schema).write.parquet(path)
    return schema


def fit_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the stored schema: cast where possible, NULL where absent."""
    kinds = {v: k for k, v in SQL_TYPES.items()}
    present = {f.name: kinds[f.dataType] for f in schema if f.name in df.columns and f.dataType in kinds}
    cast = coerce_values(df, present)
    return cast.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def append_rows(df: DataFrame, path: str, schema: T.StructType, required: tuple[str, ...] = ("id",)) -> DataFrame:
    """Append the rows whose required fields survive the cast; returns the refused rows."""
    fitted = fit_schema(df, schema)
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    fitted.filter(complete).write.mode("append").parquet(path)
    return fitted.filter(~complete)


def append_chunks(chunks: DataFrame, path: str, uploaded: Column | None = None) -> None:
    """One append for the whole corpus: new ids, upload time, position and metadata."""
    rows = chunks.select(
        F.expr("uuid()").alias("id"), "filename", "text", F.col("embedding").cast("array<float>").alias("embedding"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        (uploaded if uploaded is not None else F.current_timestamp()).cast("timestamp").alias("upload_date"), "metadata",
    )
    rows.write.mode("append").parquet(path)


def append_billing(rows: DataFrame, path: str) -> None:
    """Append by month, so that retention can drop whole months."""
    fitted = rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in BILLING_SCHEMA])
    fitted.write.mode("append").partitionBy("data_month").parquet(path)


def retained(df: DataFrame, ts: str, months: int, as_of: Column) -> DataFrame:
    """Rows no older than ``months`` times 30 days."""
    return df.filter(F.col(ts).cast("date") >= F.date_sub(as_of.cast("date"), months * 30))


def describe(df: DataFrame) -> DataFrame:
    """(column, type) of a table, comment rows left out."""
    rows = [(n.lower(), t.upper()) for n, t in df.dtypes if not n.startswith("#")]
    return df.sparkSession.createDataFrame(rows, "column string, type string")


def recent(df: DataFrame, ts: str, ties: list[str], n: int = 1000) -> DataFrame:
    return df.orderBy(F.desc(ts), *ties).limit(n)


def preview(df: DataFrame, key: str, filename: str, text: str, n: int = 20, chars: int = 100) -> DataFrame:
    return df.orderBy(key).limit(n).select(key, filename, F.left(text, F.lit(chars)).alias("preview"))


def index_table(chunks: DataFrame, key: str, vector: str, keep: list[str] = ()) -> DataFrame:
    """Search form of the chunk table: unit vector, norm and size, rows without a vector left out."""
    v = F.col(vector)
    return chunks.filter(v.isNotNull()).select(
        key, *keep, unit(v).alias("unit_vector"), norm(v).alias("norm"), F.size(v).alias("dimensions")
    )


def index_create(chunks: DataFrame, path: str, key: str, vector: str, keep: list[str] = ()) -> DataFrame:
    index_table(chunks, key, vector, keep).write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def index_info(index: DataFrame, uploaded: str) -> DataFrame:
    return index.agg(
        F.count("*").alias("vectors"), F.min("dimensions").alias("min_dimensions"),
        F.max("dimensions").alias("max_dimensions"), F.max(uploaded).alias("newest_upload"),
    )


# Paths that are not logged, and the length kept of a client description.
UNLOGGED_PATHS = ("/health", "/metrics", "/docs", "/openapi.json")
AGENT_CHARS = 100


def client_key(forwarded: Column, host: Column) -> Column:
    """First forwarded address, else the peer, else 'unknown'."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.nullif(first, F.lit("")), host, F.lit("unknown"))


def audit_rows(requests: DataFrame) -> DataFrame:
    """Audit form of (ts, request_id, path, status_code, duration_ms, user_agent, ...) rows."""
    level = F.when(F.col("status_code") >= 500, "error").when(F.col("status_code") >= 400, "warning").otherwise("info")
    out = requests.filter(~F.col("path").isin(*UNLOGGED_PATHS)).withColumns({
        "severity": level, "duration_ms": F.round(F.col("duration_ms").cast("decimal(38,8)"), 2).cast("double"),
    })
    if "user_agent" in requests.columns:
        out = out.withColumn("user_agent", F.left(F.coalesce("user_agent", F.lit("unknown")), F.lit(AGENT_CHARS)))
    return out
