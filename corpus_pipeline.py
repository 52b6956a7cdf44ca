"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read again for the next one. All stages but the
last give tables of documents with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import exact, langid, minhash, mixing, packing
from brindle.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no text, no letters, or long enough to tell and no more like a language than chance."""
    return langid.keep_identified(docs, langid.train_on_rest(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, A-Z lowered, the one with the largest id stays."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingles with similarity 0.8 or more, the one with the smallest id stays."""
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, always whole."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack),
]

# Hyperdimensional language profiles, the seeded mix and byte-level ids cannot be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
