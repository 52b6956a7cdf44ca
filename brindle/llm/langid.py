"""Language of a text by hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1. A three-letter sequence is bound to one vector by rotating the first letter
twice and the second once and multiplying all three; a text is the sum of its sequences, and so is a
language over its training texts. The language whose sum has the greatest cosine with that of the text is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.memory import give_back

DIMENSIONS = 1024
SEED = 20_231
UNKNOWN = "und"
# A model is one vector per language and goes to all tasks, so the number of languages has a bound that is checked.
MAX_LANGUAGES = 1_000
# Code points of texts that are worked on together, and sequences whose vectors are held at a time.
SLICE_LETTERS, HELD_SEQUENCES = 1 << 18, 1 << 13
BITS = 21
COUNTS = "lang string, sequence bigint, n bigint"
# How far above chance a cosine has to be, in standard deviations, and the length from which it can be told.
NOISE_DEVIATIONS, SHORT_TEXT = 4.0, 64


_alphabet: np.ndarray | None = None


def _letters_of(points: np.ndarray) -> np.ndarray:
    """Code points with everything that is not a letter set to 0."""
    global _alphabet
    if _alphabet is None:
        _alphabet = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(_alphabet[points], points, 0)


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, code of the sequence) of all three-letter sequences.

    Letters are lowered; everything between words counts as one gap, also at both ends.
    """
    low = [(t or "").lower() for t in texts]
    joined = "\0" + "\0\0".join(low) + "\0"
    points = _letters_of(np.frombuffer(joined.encode("utf-32-le"), "<u4")).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in low])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])
    points, owner = points[keep], owner[keep]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]
    inside = (owner[:-2] == owner[2:]) & (points[1:-1] != 0)
    return owner[:-2][inside], codes[inside]


class Vectors:
    """Letter vectors made from the letter and the seed alone, and what is bound from them."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed, self.letters = dimensions, seed, {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            bits = np.random.default_rng((self.seed, point)).integers(0, 2, self.dimensions)
            self.letters[point] = (2 * bits - 1).astype(np.int8)
        return self.letters[point]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """Float rows of the sequences ``codes``."""
        out = None
        for shift, turn in ((2 * BITS, 2), (BITS, 1), (0, 0)):
            points, at = np.unique(codes >> shift & (1 << BITS) - 1, return_inverse=True)
            rows = np.stack([np.roll(self.letter(int(p)), turn) for p in points])[at]
            out = rows if out is None else out * rows
        return out.astype(np.float32)

    def bundled(self, owner: np.ndarray, codes: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
        """Sum of the sequence vectors of each of ``n`` owners."""
        out = np.zeros((n, self.dimensions), np.float32 if weights is None else np.float64)
        known, at = _compact(codes)
        for lo in range(0, len(known), HELD_SEQUENCES):
            hi = min(lo + HELD_SEQUENCES, len(known))
            some = slice(None) if hi - lo == len(known) else (at >= lo) & (at < hi)
            cell = owner[some] * (hi - lo) + at[some] - lo
            counts = np.bincount(cell, None if weights is None else weights[some], minlength=n * (hi - lo))
            out += counts.reshape(n, hi - lo).astype(out.dtype) @ self.bound(known[lo:hi]).astype(out.dtype)
        return out


def _compact(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, and the place of each code among them; by a table where the letters are few."""
    parts = [codes >> 2 * BITS, codes >> BITS & (1 << BITS) - 1, codes & (1 << BITS) - 1]
    seen = np.zeros(1 << BITS, bool)
    for p in parts:
        seen[p] = True
    letters = np.flatnonzero(seen)
    if len(letters) > 160:
        return np.unique(codes, return_inverse=True)
    number = np.zeros(1 << BITS, np.int64)
    number[letters] = np.arange(len(letters))
    k = len(letters)
    dense = (number[parts[0]] * k + number[parts[1]]) * k + number[parts[2]]
    used = np.flatnonzero(np.bincount(dense, minlength=k**3))
    place = np.zeros(k**3, np.int64)
    place[used] = np.arange(len(used))
    a, rest = np.divmod(used, k * k)
    b, c = np.divmod(rest, k)
    return letters[a] << 2 * BITS | letters[b] << BITS | letters[c], place[dense]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 2
        if size >= SLICE_LETTERS or i + 1 - lo >= 512:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class Model:
    """Language names in order and one unit vector per language."""

    languages: list[str]
    prototypes: np.ndarray
    dimensions: int
    seed: int


def sequence_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, sequence, n) over whole texts, added up per batch before the shuffle."""

    def count(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {name: i for i, name in enumerate(names)}
            for lo, hi in _slices(texts):
                owner, codes = sequences(texts[lo:hi])
                if not len(codes):
                    continue
                known, at = _compact(codes)
                cell = np.array([number[x] for x in langs[lo:hi]])[owner] * len(known) + at
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in cells // len(known)]), pa.array(known[cells % len(known)]), pa.array(n)],
                    names=["lang", "sequence", "n"])
        give_back()

    rows = labelled.select(text, lang).filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).mapInArrow(count, COUNTS)
    return rows.groupBy("lang", "sequence").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> Model:
    """Prototypes from all rows with a text and a language; nothing is sampled.

    The sums are made where the counts lie; only one vector per language comes to the driver. ValueError beyond
    ``MAX_LANGUAGES`` languages. Languages without a letter in any text are not learned.
    """

    def bundle(batches):
        vectors = Vectors(dimensions, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {name: i for i, name in enumerate(names)}
            owner = np.array([number[x] for x in langs])
            sums = vectors.bundled(owner, batch.column("sequence").to_numpy(), batch.column("n").to_numpy(), len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, dimensions), pa.string()), pa.array(np.tile(np.arange(dimensions), len(names)), pa.int32()),
                 pa.array(sums.ravel())], names=["lang", "place", "value"])

    counts = sequence_counts(labelled, text, lang)
    sums = counts.mapInArrow(bundle, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
    rows = vectors.select("lang", F.transform("v", lambda x: x["value"]).alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.array([r.v for r in rows], np.float64).reshape(len(rows), dimensions)
    return Model([r.lang for r in rows], _unit(table), dimensions, seed)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def predict(texts: list[str | None], model: Model, vectors: Vectors) -> tuple[list[str], np.ndarray]:
    """Language and cosine, at least 0, of each text; ties go to the first language by name."""
    names, scores = [], []
    for lo, hi in _slices(texts):
        owner, codes = sequences(texts[lo:hi])
        sums = vectors.bundled(owner, codes, None, hi - lo)
        lettered = np.bincount(owner, minlength=hi - lo) > 0
        if not model.languages:
            names += [UNKNOWN] * (hi - lo)
            scores.append(np.zeros(hi - lo))
            continue
        cosines = _unit(sums.astype(np.float64)) @ model.prototypes.T
        best = cosines.argmax(axis=1)
        names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        scores.append(np.where(lettered, cosines[np.arange(hi - lo), best].clip(0, 1), 0.0))
    return names, np.concatenate(scores) if scores else np.empty(0)


def language_of(text: Column, model: Model) -> Column:
    """struct(lang, score) of a text column; ``und`` with score 0 for NULL and for texts without letters."""

    @F.pandas_udf("lang string, score double")
    def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(model.dimensions, model.seed)
        part = None
        for part in parts:
            names, scores = predict([t if isinstance(t, str) else None for t in part], model, vectors)
            yield pd.DataFrame({"lang": names, "score": scores})
        del part, vectors
        give_back()

    return identify(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, divided by four, leaves 2. False for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_rest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Model of the documents that are not held out. Rows without an id have no remainder and are not learned from."""
    return train(docs.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))), text, lang)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row, learned from the rows that are not held out.

    NULL texts and texts without letters are ``und`` with score 0, as is every text when nothing could be learned.
    Repeated rows are answered each. An empty table gives an empty table.
    """
    model = train_on_rest(docs, doc_id, text, lang)
    found = docs.select(
        F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), language_of(F.col(text), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_identified(docs: DataFrame, model: Model, text: str = "text", deviations: float = NOISE_DEVIATIONS, short: int = SHORT_TEXT) -> DataFrame:
    """The rows whose text has letters and is like a language of the model; all columns, no shuffle.

    Unrelated texts have cosines that scatter around 0 by 1 over the root of the dimensions; a text has to exceed ``deviations`` times that. One of fewer
    than ``short`` characters may have a language and yet no more than noise, so it stays if it has letters. With no language to compare none stays.
    """
    found = "__language"
    rows = docs.withColumn(found, language_of(F.col(text), model))
    like = F.col(f"{found}.score") > deviations / model.dimensions**0.5
    return rows.filter((F.col(f"{found}.lang") != UNKNOWN) & (like | (F.char_length(text) < short))).drop(found)
