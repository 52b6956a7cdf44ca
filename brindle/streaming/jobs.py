"""Streaming jobs: windowed counts, index refresh and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.numbers import round_to
from brindle.sources.tables import audit_rows, index_table

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_time(df: DataFrame, ts: str) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def window_counts(
    events: DataFrame, ts: str, keys: list[str], value: str, length: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Calls and value total per key and window; works on tables and, with a watermark, on streams."""
    span = F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)
    counted = events.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), round_to(F.sum(value), 2).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, append it to ``path`` and return the table."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def index_sync(
    chunks: DataFrame, path: str, checkpoint: str, key: str, vector: str, keep: list[str] = (), interval: str | None = None
):
    """Add newly arrived chunks to the index table.

    Without ``interval`` the waiting files are processed and the call returns (a triggered sync);
    with it the stream keeps running (a continuous sync). A micro-batch writes to its own folder, so
    repeating it after a failure replaces its rows instead of adding them twice.
    """
    def add(batch: DataFrame, number: int) -> None:
        index_table(batch, key, vector, keep).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def audit_stream(requests: DataFrame, ts: str, request_id: str, late: str = WATERMARK) -> DataFrame:
    """Audit rows, each request once even when it is delivered again."""
    unique = with_time(requests, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([request_id])
    return audit_rows(unique)

