"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "brindle") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BRINDLE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a private one only when unset on a local master."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="brindle-")
        _own[context.applicationId] = root
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """New location below the shared folder; nothing is overwritten or cleared."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df, label: str):
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, key: str):
    """Rows dealt over all cores when the scan has fewer parts than cores, else ``df`` as it is.

    A file of one row group is one task however large it is; work that is heavy per row is worth a shuffle
    then. A scan that is split already is not shuffled. The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
