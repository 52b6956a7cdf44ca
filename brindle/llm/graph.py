"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import written


def _smallest_neighbours(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both, both.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the smallest node around it."""
    both, smallest = _smallest_neighbours(links)
    return both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them. Links lead from great to small."""
    smallest = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(smallest.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _sign(links: DataFrame):
    """What tells a set of links from another."""
    return links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; ``component`` is the smallest node reachable.

    Large and small stars in turn until nothing moves; each round is written to the shared folder, so no lineage grows and a lost
    executor repeats one round at most. Links of a node to itself or to NULL are ignored.
    """
    real = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = real.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = written(now, "links")
    before = _sign(now)
    while True:
        stars = written(_small_star(_large_star(now)), "stars")
        sign = _sign(stars)
        if sign == before:
            ends = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return ends.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now, before = stars, sign
