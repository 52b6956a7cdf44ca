"""Document chunking. A chunk's start depends on the one before it, so a document is cut in one call;
the work is spread over documents in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.vectors import hash_embedding

# Characters per chunk and words shared by neighbours.
CHUNK_CHARS, OVERLAP_WORDS = 512, 50
# Texts whose pieces a worker holds at a time.
TEXTS = 128
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def _ends(words: list[str]) -> np.ndarray:
    """Running length with one separator per word, starting at 0."""
    return np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))


def word_spans(words: list[str], size: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges that reach ``size`` characters; the next range steps back, but always moves on."""
    total, spans, start = _ends(words), [], 0
    while start < len(words):
        end = min(int(np.searchsorted(total, total[start] + size)), len(words))
        spans.append((start, end))
        if end == len(words):
            break
        start = end - overlap if end - overlap > start else end
    return spans


def sentence_pieces(text: str, size: int) -> list[str]:
    """Sentences packed up to ``size``; a longer sentence is cut by words, which starts a new piece, and its rest is packed on.

    A unit is a sentence or a cut of one, its cost the room it takes with the separator (two more for cuts). A piece
    reaches as far as the running cost allows, or to the next cut. It has one character less where nothing was left over from
    before: at the start and after a full cut.
    """
    units: list[str] = []
    costs: list[int] = []
    cuts: list[int] = []
    for sentence in filter(None, (s.strip() for s in _SENTENCE_END.split(text))):
        if len(sentence) <= size:
            units.append(sentence)
            costs.append(len(sentence) + 1)
            continue
        words = sentence.split()
        for first, last in word_spans(words, size, 0):
            cuts.append(len(units))
            units.append(" ".join(words[first:last]))
            costs.append(len(units[-1]) + 2)
    total, pieces, at = np.concatenate(([0], np.cumsum(costs))), [], 0
    bounds = np.array([*cuts, len(units)])
    is_cut = set(cuts)
    while at < len(units):
        clean = at not in is_cut and (at == 0 or at - 1 in is_cut and costs[at - 1] > size)
        reached = int(np.searchsorted(total, total[at] + size + (not clean), side="right")) - 1
        end = min(max(reached, at + 1), int(bounds[np.searchsorted(bounds, at, side="right")]))
        pieces.append(" ".join(units[at:end]))
        at = end
    return pieces


def _cutter(cut: Callable[[str], list[str]]):
    """Arrow-batched function from text to its pieces. They leave after every ``TEXTS`` texts, so a worker never holds those of a whole batch."""
    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if not len(texts):
                yield pd.Series([], dtype=object)
            for lo in range(0, len(texts), TEXTS):
                yield pd.Series([cut(t) if t else [] for t in texts.iloc[lo:lo + TEXTS]])

    return pieces


def word_cutter(size: int = CHUNK_CHARS, overlap: int = OVERLAP_WORDS):
    def cut(text: str) -> list[str]:
        words = text.split()
        return [" ".join(words[a:b]) for a, b in word_spans(words, size, overlap)]

    return _cutter(cut)


def sentence_cutter(size: int = CHUNK_CHARS):
    return _cutter(lambda text: sentence_pieces(text, size))


def _explode(df: DataFrame, keep: list[str], pieces: Column) -> DataFrame:
    return df.select(*keep, F.posexplode(pieces).alias("chunk_index", "chunk"))


def chunk_words(df: DataFrame, keep: list[str], text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    return _explode(df, keep, word_cutter(size, overlap)(F.col(text)))


def chunk_sentences(df: DataFrame, keep: list[str], text: str, size: int = CHUNK_CHARS) -> DataFrame:
    return _explode(df, keep, sentence_cutter(size)(F.col(text)))


def chunk_corpus(df: DataFrame, doc_id: str, filename: str, text: str) -> DataFrame:
    """(doc_id, filename, chunk_index, text, metadata) for every document."""
    chunks = chunk_words(df, [doc_id, filename], text)
    return chunks.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(filename).alias("filename"), "chunk_index",
        F.col("chunk").alias("text"),
        F.create_map(F.lit("source"), F.lit("upload"), F.lit("doc_id"), F.col(doc_id).cast("string")).alias("metadata"),
    )


def embed(df: DataFrame, text: str, model=None, out: str = "embedding") -> DataFrame:
    """Adds a vector per row: the hash stand-in, or ``model(texts: pd.Series) -> list of vectors`` in Arrow batches."""
    if model is None:
        return df.withColumn(out, hash_embedding(F.col(text)))

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in model(texts)])

    return df.withColumn(out, vectors(F.col(text)))


@F.udtf(returnType="chunk_index int, chunk string")
class ChunkTable:
    """Table function: ``SELECT * FROM docs, LATERAL chunk_table(text)``."""

    def eval(self, text: str):
        words = (text or "").split()
        for i, (a, b) in enumerate(word_spans(words, CHUNK_CHARS, OVERLAP_WORDS)):
            yield i, " ".join(words[a:b])


def register_functions(spark: SparkSession) -> None:
    """``chunk_words(text)`` and ``chunk_sentences(text)`` as SQL functions, ``chunk_table`` as a table function."""
    spark.udf.register("chunk_words", word_cutter())
    spark.udf.register("chunk_sentences", sentence_cutter())
    spark.udtf.register("chunk_table", ChunkTable)
