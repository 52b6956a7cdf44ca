"""Registered queries: name -> DataFrame builder, and name -> the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Parquet tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def wide(self, name: str, key: str) -> DataFrame:
        """The table for work that is heavy per row."""
        return spread(getattr(self, name), key)

    def stream_path(self, name: str) -> str:
        """A pattern, as a stream does not start from the path of a single file."""
        return f"{self.folder}/{name}.parquet*"


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` and, where SQL can say it, the checking SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rd(expression: str, digits: int) -> str:
    """SQL twin of ``round_to``."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def load_all() -> None:
    from importlib import import_module

    for part in (
        "tables", "cleaning", "predicates", "statistics", "shapes", "series", "scalars",
        "retrieval", "questions", "models", "streams", "charts", "joins", "sessions", "index", "algebra",
    ):
        import_module(f"brindle.queries.{part}")
