"""Late events kept apart, and output that counts once however often a batch is repeated.

A sink folder holds one folder per micro-batch for each of its tables and, written last, one for the batch's mark: the greatest event
time seen so far. A batch counts when its mark is there. A batch repeated after a failure has the same rows, reads the marks of earlier batches only, and
replaces its own folders, so readers see the same rows whenever and however often the writer stopped.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ON_TIME, LATE, MARKS = "on_time", "late", "marks"
MARK = "batch_id long, seen timestamp, n long, n_late long"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The marks of the batches that count, one row per batch."""
    return _read(spark, f"{path}/{MARKS}", T._parse_datatype_string(MARK))


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(f"{path}/*") if store.exists(folder) else spark.createDataFrame([], schema)


def read_committed(spark: SparkSession, path: str, part: str, schema: T.StructType) -> DataFrame:
    """Rows of ``part`` of the batches that count, with ``batch_id``."""
    rows = _read(spark, f"{path}/{part}", T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
    return rows.join(committed(spark, path).select("batch_id"), "batch_id", "left_semi")


def late_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("lateness_seconds", T.DoubleType())])


class LateSplit:
    """Writer of micro-batches: events on time to one table, late ones with their lateness to another.

    An event is late when its time lies more than ``delay`` before the greatest time of all earlier batches. Events without a time are on time.
    """

    def __init__(self, path: str, ts: str, delay: timedelta):
        self.path, self.ts, self.delay = path, ts, delay

    def write(self, batch: DataFrame, number: int) -> None:
        self._tables(batch, number)
        self._commit(batch, number)

    def _split(self, batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        before = committed(batch.sparkSession, self.path).filter(F.col("batch_id") < number).agg(F.max("seen")).first()[0]
        bound = F.lit(before).cast("timestamp") - F.lit(self.delay)
        lateness = (F.unix_micros(bound) - F.unix_micros(F.col(self.ts).cast("timestamp"))) / 1_000_000
        rows = batch.withColumn("lateness_seconds", F.when(lateness > 0, lateness))
        return rows.filter("lateness_seconds IS NULL").drop("lateness_seconds"), rows.filter("lateness_seconds IS NOT NULL")

    def _tables(self, batch: DataFrame, number: int) -> None:
        for part, rows in zip((ON_TIME, LATE), self._split(batch, number)):
            rows.withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{part}/batch-{number}")

    def _commit(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        n_late = spark.read.parquet(f"{self.path}/{LATE}/batch-{number}").count()
        row = batch.agg(F.max(F.col(self.ts).cast("timestamp")).alias("seen"), F.count("*").alias("n"))
        mark = row.select(F.lit(number).cast("long").alias("batch_id"), "seen", "n", F.lit(n_late).cast("long").alias("n_late"))
        mark.write.mode("overwrite").parquet(f"{self.path}/{MARKS}/batch-{number}")

    def start(self, events: DataFrame, checkpoint: str, interval: str | None = None):
        """Process what waits and return, or with ``interval`` go on."""
        writer = events.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        if interval:
            return writer.trigger(processingTime=interval).start()
        running = writer.trigger(availableNow=True).start()
        running.awaitTermination()
        return running
