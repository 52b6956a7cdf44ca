"""Exact top-k retrieval by vectors and by terms, and context assembly.

The question table is written once to the shared folder. Every task reads it in blocks of bounded size next to each batch of
its chunks, so the chunk table is scanned once whatever the number of questions, and no question passes through the driver. A
partition keeps its own k best for a bounded number of questions; those of further questions leave with every batch. All are merged per question, so
neither way changes the answer, and a worker's memory does not grow with the questions.

Vectors are compared in single precision first. What that leaves out is further from a question's k best than the error of such products,
whatever the vectors; the rest, few pairs as a rule, are scored in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.functions.numbers import round_to
from brindle.functions.text import question_terms
from brindle.session import fresh_path

QUERY_BLOCK = 1024
# Questions whose best chunks a worker keeps over its whole partition.
HELD_QUESTIONS = 1 << 15
# Chunks that a block of questions is scored against at once, which keeps the scores at 16 MB and the differences of vectors in the cache.
CHUNK_SLICE = 2048
# Components of the chunk vectors that meet all questions at once, and of the pairs compared in double precision at once.
PASS_NUMBERS, PAIR_NUMBERS = 1 << 22, 1 << 20
# Chunks of a slice that may be left to a question by single precision; beyond that its whole slice is scored in double precision.
NEAR_CHUNKS = 256
# Vectors longer than this, or shorter but not zero, are left to double precision.
LONGEST, SHORTEST = 1e15, 1e-15
# questions per block and texts per slice of the term search, which keep its matrices at a few megabytes
TERM_BLOCK, TEXT_SLICE = 256, 512
SCORE_DIGITS = 9
CONTEXT_CHARS, CONTEXT_RULE = 1500, "\n\n---\n\n"

# Scores of one batch of chunks: one row per question of the block.
Score = Callable[[pd.Series], np.ndarray]


def question_blocks(path: str, block: int) -> Iterator[pd.DataFrame]:
    """Blocks of a written question table, in the same order every time."""
    store, root = fs.FileSystem.from_uri(path)
    files = store.get_file_info(fs.FileSelector(root))
    for name in sorted(f.path for f in files if f.base_name.endswith(".parquet")):
        with store.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(block):
                if batch.num_rows:
                    yield batch.to_pandas()


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, equal scores by id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _scan(
    queries: DataFrame, chunks: DataFrame, key: str, payload: str, k: int, block: int,
    scorer: Callable[[pd.DataFrame], Score], schema: str, floor: float | None = None,
) -> DataFrame:
    """k best chunks per question; ``scorer`` prepares a block of (q, ...) questions."""
    path = fresh_path(queries.sparkSession, "questions")
    queries.write.parquet(path)

    keep_blocks = HELD_QUESTIONS // block

    def better(own: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores, names = np.concatenate((own[0], scores)), np.concatenate((own[1], ids))
        if floor is not None:
            keep = scores > floor
            scores, names = scores[keep], names[keep]
        best = _best(scores, names, k)
        return scores[best], names[best]

    def rows(asked: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame({"query_id": asked[q], "chunk_id": names, "score": scores}) for q, (scores, names) in enumerate(found) if len(scores)]
        if parts:
            yield pd.concat(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = np.empty(0), np.empty(0, dtype=object)
        held: list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = []
        for batch in batches:
            ids = batch[key].to_numpy(dtype=object)
            for place, some in enumerate(question_blocks(path, block)):
                score = scorer(some)
                if place == len(held) and place < keep_blocks:
                    held.append((some["q"].to_numpy(dtype=object), [nothing] * len(some)))
                own = held[place][1] if place < keep_blocks else [nothing] * len(some)
                for start in range(0, len(batch), CHUNK_SLICE):
                    part = slice(start, start + CHUNK_SLICE)
                    own[:] = [better(before, row, ids[part]) for before, row in zip(own, score(batch[payload].iloc[part]))]
                if place >= keep_blocks:
                    yield from rows(some["q"].to_numpy(dtype=object), own)
        for asked, own in held:
            yield from rows(asked, own)

    return chunks.select(key, payload).mapInPandas(run, schema)


def _merge(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(vectors: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length stacked, and a mask of which rows those are."""
    fits = np.array([v is not None and len(v) == size for v in vectors], dtype=bool)
    out = np.zeros((len(vectors), size))
    if fits.any():
        out[fits] = np.stack([np.asarray(v, dtype=float) for v, ok in zip(vectors, fits) if ok])
    return out, fits


def _vector_scorer(metric: str, unit: bool) -> Callable[[pd.DataFrame], Score]:
    def of_size(queries: np.ndarray) -> Score:
        norms = np.linalg.norm(queries, axis=1)

        def score(vectors: pd.Series) -> np.ndarray:
            rows, fits = _matrix(vectors, queries.shape[1])
            products = queries @ rows.T
            if metric == "cosine":
                lengths = np.outer(norms, fits.astype(float) if unit else np.linalg.norm(rows, axis=1))
                out = np.divide(products, lengths, out=np.zeros_like(products), where=lengths > 0)
            elif metric == "euclidean":
                out = np.stack([-np.linalg.norm(rows - q, axis=1) for q in queries])
                out[:, ~fits] = -np.inf
            else:
                out = products
                out[:, ~fits] = -np.inf
            return np.round(out, SCORE_DIGITS)

        return score

    def prepare(some: pd.DataFrame) -> Score:
        sizes = some["v"].map(lambda v: 0 if v is None else len(v)).to_numpy()
        groups = []
        for size in np.unique(sizes):
            places = np.flatnonzero(sizes == size)
            rows = [np.asarray(some["v"].iloc[i], dtype=float) for i in places] if size else None
            groups.append((places, of_size(np.stack(rows)) if size else None))

        def score(vectors: pd.Series) -> np.ndarray:
            # a question without a vector is as far from everything as one of another length
            out = np.full((len(some), len(vectors)), 0.0 if metric == "cosine" else -np.inf)
            for places, own in groups:
                if own is not None:
                    out[places] = own(vectors)
            return out

        return score

    return prepare


def _numbers(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a list column by size; NULL counts as a vector without components."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    found = {}
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        flat = (column if len(places) == len(column) else column.take(pa.array(places))).flatten() if size else pa.array([], pa.float64())
        found[size] = places, flat.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(len(places), size)
    return found


class _Hits:
    """The k best chunks of a block of questions so far."""

    def __init__(self, n: int, k: int, kind: np.dtype):
        self.scores, self.names, self.found = np.full((n, k), -np.inf), np.empty((n, k), kind), np.zeros(n, np.int64)

    def add(self, who: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        """Takes in hits of the questions ``who``; equal scores go by chunk."""
        k = self.scores.shape[1]
        own = np.unique(who)
        have = np.arange(k) < self.found[own, None]
        who = np.concatenate((np.repeat(own, self.found[own]), who))
        scores = np.concatenate((self.scores[own][have], scores))
        names = np.concatenate((self.names[own][have], names))
        order = np.lexsort((names, -scores, who))
        who, scores, names = who[order], scores[order], names[order]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        counts = np.diff(np.r_[starts, len(who)])
        rank = np.arange(len(who)) - np.repeat(starts, counts)
        best = rank < k
        self.scores[who[best], rank[best]], self.names[who[best], rank[best]] = scores[best], names[best]
        self.found[own] = np.minimum(counts, k)

    def edge(self) -> np.ndarray:
        """Score that a chunk needs at least, per question."""
        return self.scores[:, -1]


class _Near:
    """Vectors of one size as single-precision points whose products order as the metric does, with the error of a product.

    A point of a chunk is its vector, for cosine at length one, for distances with half its square below zero as a further component.
    """

    def __init__(self, metric: str, vectors: np.ndarray):
        self.metric, self.vectors = metric, vectors
        self.lengths = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
        with np.errstate(invalid="ignore"):
            self.plain = (self.lengths <= LONGEST) & ((self.lengths >= SHORTEST) | (self.lengths == 0)) & np.isfinite(vectors).all(axis=1)

    def unit(self) -> np.ndarray:
        return np.divide(self.vectors, self.lengths[:, None], out=np.zeros_like(self.vectors), where=self.lengths[:, None] > 0)

    def chunks(self) -> np.ndarray:
        if self.metric == "cosine":
            return self.unit().astype(np.float32)
        if self.metric == "euclidean":
            return np.hstack((self.vectors, -0.5 * self.lengths[:, None] ** 2)).astype(np.float32)
        return self.vectors.astype(np.float32)

    def questions(self) -> np.ndarray:
        if self.metric == "euclidean":
            return np.hstack((self.vectors, np.ones((len(self.vectors), 1)))).astype(np.float32)
        return self.chunks()

    def error(self, longest: float) -> np.ndarray:
        """Greatest error of a question's product with a chunk no longer than ``longest``, components rounded to single precision before."""
        step = 2.0 ** -23 * (self.vectors.shape[1] + 8)
        if self.metric == "cosine":
            return np.full(len(self.vectors), step)
        return step * (self.lengths * longest + (longest * longest if self.metric == "euclidean" else 0)) + 1e-30

    def least(self, edge: np.ndarray) -> np.ndarray:
        """Product that a chunk of the score ``edge`` has, were there no error; a little less, as scores are rounded."""
        slack = 10.0 ** -SCORE_DIGITS + 1e-12 * np.abs(np.where(np.isfinite(edge), edge, 0))
        if self.metric == "euclidean":
            far = np.where(np.isfinite(edge), slack - edge, np.inf)
            return 0.5 * (self.lengths ** 2 - far ** 2) - 1e-12 * self.lengths ** 2
        return edge - slack

    def scores(self, who: np.ndarray, other: _Near, what: np.ndarray) -> np.ndarray:
        """Score of each pair in double precision."""
        a, b = self.vectors[who], other.vectors[what]
        if self.metric == "euclidean":
            out = -np.linalg.norm(b - a, axis=1)
        else:
            out = np.einsum("nd,nd->n", a, b)
            if self.metric == "cosine":
                lengths = self.lengths[who] * other.lengths[what]
                out = np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0)
        return np.round(out, SCORE_DIGITS)

    def some(self, which: np.ndarray) -> _Near:
        part = object.__new__(_Near)
        part.metric, part.vectors, part.lengths, part.plain = self.metric, self.vectors[which], self.lengths[which], self.plain[which]
        return part


def _take_dense(hits: _Hits, places: np.ndarray, asked: np.ndarray, chunks: np.ndarray, names: np.ndarray, metric: str) -> None:
    """All pairs of some questions and chunks in double precision, a few questions at a time."""
    k = hits.scores.shape[1]
    rows = pd.Series(list(chunks))
    for lo in range(0, len(places), 64):
        some = slice(lo, lo + 64)
        score = _vector_scorer(metric, False)(pd.DataFrame({"v": list(asked[some])}))
        for start in range(0, len(chunks), CHUNK_SLICE):
            part = slice(start, start + CHUNK_SLICE)
            for place, row in zip(places[some], score(rows.iloc[part])):
                best = _best(row, names[part], k)
                if metric != "cosine":
                    best = best[row[best] > -np.inf]
                if len(best):
                    hits.add(np.full(len(best), place), row[best], names[part][best])


def _take(hits: _Hits, places: np.ndarray, asked: _Near, points: np.ndarray, chunks: _Near, near: np.ndarray, names: np.ndarray) -> None:
    """The best of a slice of chunks for the questions at ``places``; ``points`` and ``near`` are both sides in single precision."""
    k = hits.scores.shape[1]
    error = asked.error(float(chunks.lengths.max()))
    products = points @ near.T
    least = asked.least(hits.edge()[places]) - error
    short = np.flatnonzero(hits.found[places] < k)
    if len(short) and len(names) > k:
        least[short] = np.partition(products[short], len(names) - k, axis=1)[:, len(names) - k] - 2 * error[short] - 2 * 10.0 ** -SCORE_DIGITS * (
            1 if asked.metric != "euclidean" else 1 + asked.lengths[short] + chunks.lengths.max())
    elif len(short):
        least[short] = -np.inf
    # a bound in single precision must not be rounded upwards
    bound = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
    # few questions find anything in a slice once they have seen others
    some = np.flatnonzero(products.max(axis=1) >= bound)
    who, what = np.divmod(np.flatnonzero(products[some] >= bound[some, None]), len(names))
    who = some[who]
    counts = np.bincount(who, minlength=len(places))
    crowded = counts > max(NEAR_CHUNKS, k)
    if crowded.any():
        _take_dense(hits, places[crowded], asked.vectors[crowded], chunks.vectors, names, asked.metric)
        kept = ~crowded[who]
        who, what = who[kept], what[kept]
    step = max(1, PAIR_NUMBERS // asked.vectors.shape[1])
    parts = [asked.scores(who[lo:lo + step], chunks, what[lo:lo + step]) for lo in range(0, len(who), step)]
    if parts:
        hits.add(places[who], np.concatenate(parts), names[what])


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Names and vectors of the chunks, as many as meet all questions at once."""
    held, numbers = [], 0

    def whole() -> tuple[np.ndarray, pa.Array]:
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.column(0).combine_chunks()
        plain = pa.types.is_integer(names.type) and not names.null_count
        return names.to_numpy() if plain else np.array([*names.to_pylist(), None], dtype=object)[:-1], table.column(1).combine_chunks()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            numbers += batch.num_rows + len(batch.column(1).flatten())
            if numbers >= PASS_NUMBERS:
                yield whole()
                held, numbers = [], 0
    if held:
        yield whole()


def _asked_blocks(path: str, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a written question table, in the same order every time."""
    store, root = fs.FileSystem.from_uri(path)
    files = store.get_file_info(fs.FileSelector(root))
    for name in sorted(f.path for f in files if f.base_name.endswith(".parquet")):
        with store.open_input_file(name) as source:
            yield from (batch for batch in pq.ParquetFile(source).iter_batches(block) if batch.num_rows)


def _scan_vectors(queries: DataFrame, chunks: DataFrame, key: str, vector: str, k: int, block: int, metric: str, schema: str) -> DataFrame:
    """k best chunks of a partition per question (q, v)."""
    path = fresh_path(queries.sparkSession, "questions")
    queries.write.parquet(path)
    asked_kind, named_kind = to_arrow_type(queries.schema["q"].dataType), to_arrow_type(chunks.schema[key].dataType)
    keep_blocks = HELD_QUESTIONS // block

    def meet(hits: _Hits, some: pa.RecordBatch, names: np.ndarray, sizes: dict, ready: dict) -> None:
        for size, (places, vectors) in _numbers(some.column("v")).items():
            if metric == "cosine":
                # chunks of another size score 0: only the first of them can be hits
                rest = [names[at] for other, (at, _) in sizes.items() if other != size or not size]
                if rest:
                    rest = np.sort(np.concatenate(rest))[:k]
                    hits.add(np.repeat(places, len(rest)), np.zeros(len(places) * len(rest)), np.tile(rest, len(places)))
            if not size or size not in sizes:
                continue
            at, chunk = sizes[size]
            if size not in ready:
                ready[size] = (rows := _Near(metric, chunk)), rows.some(rows.plain), rows.some(rows.plain).chunks()
            rows, plain, near = ready[size]
            asked = _Near(metric, vectors)
            odd = ~asked.plain
            own = names[at]
            if odd.any():
                _take_dense(hits, places[odd], vectors[odd], chunk, own, metric)
            if odd.all():
                continue
            asked, places = asked.some(~odd), places[~odd]
            if not rows.plain.all():
                _take_dense(hits, places, asked.vectors, chunk[~rows.plain], own[~rows.plain], metric)
            points, own = asked.questions(), own[rows.plain]
            for lo in range(0, len(own), CHUNK_SLICE):
                part = np.arange(lo, min(lo + CHUNK_SLICE, len(own)))
                _take(hits, places, asked, points, plain.some(part), near[part], own[part])

    def rows_of(ids: pa.Array, hits: _Hits) -> pa.RecordBatch:
        have = np.arange(k) < hits.found[:, None]
        who = np.nonzero(have)[0]
        names = hits.names[have]
        columns = [ids.take(pa.array(who)).cast(asked_kind), pa.array(names.tolist() if names.dtype == object else names, named_kind), pa.array(hits.scores[have])]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, _Hits]] = []
        for names, vectors in _passes(batches):
            sizes, ready = _numbers(vectors), {}
            for place, some in enumerate(_asked_blocks(path, block)):
                if place < keep_blocks:
                    if place == len(held):
                        held.append((some.column("q"), _Hits(some.num_rows, k, names.dtype)))
                    hits = held[place][1]
                    if hits.names.dtype != names.dtype:
                        hits.names = hits.names.astype(object)
                else:
                    hits = _Hits(some.num_rows, k, names.dtype)
                meet(hits, some, names, sizes, ready)
                if place >= keep_blocks:
                    yield rows_of(some.column("q"), hits)
        for ids, hits in held:
            yield rows_of(ids, hits)

    return chunks.select(key, vector).mapInArrow(run, schema)


def vector_search(
    queries: DataFrame, chunks: DataFrame, query_key: str, query_vector: str, chunk_key: str, vector: str,
    k: int = 5, metric: str = "cosine", where: Column | None = None, block: int = QUERY_BLOCK, unit: bool = False,
) -> DataFrame:
    """(query_id, chunk_id, score, rank). ``where`` is applied to the chunk table before scoring.

    Cosine is 0 for a zero vector or another length, also for a question without a vector; the other metrics leave such
    chunks out. Euclidean scores are negative distances, so larger is always better. ``unit`` says that the chunk vectors have
    length one, as those of the index table do; their norms are taken once a pass and need not be spared.
    """
    rows = chunks.filter(where) if where is not None else chunks
    schema = f"query_id {_type(queries, query_key)}, chunk_id {_type(chunks, chunk_key)}, score double"
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vector).alias("v"))
    return _merge(_scan_vectors(asked, rows, chunk_key, vector, k, block, metric, schema), k)


def _term_scorer(place: dict[str, int], weights: np.ndarray) -> Callable[[pd.Series], np.ndarray]:
    """Scores by contained terms. A term holds no space, so a text contains it when one of its words does;
    the terms inside a word are found once per distinct word."""
    sizes = sorted({len(term) for term in place})

    def terms_in(word: str) -> list[int]:
        inside = set()
        for size in sizes:
            if size > len(word):
                break
            inside.update(place[piece] for i in range(len(word) - size + 1) if (piece := word[i : i + size]) in place)
        return list(inside)

    def score(texts: pd.Series) -> np.ndarray:
        known: dict[str, list[int]] = {}
        parts = []
        for start in range(0, len(texts), TEXT_SLICE):
            some = texts.iloc[start : start + TEXT_SLICE]
            present = np.zeros((len(some), len(place)), dtype=np.float32)
            for row, text in zip(present, some):
                for word in set(text.split()):
                    hits = known.get(word)
                    if hits is None:
                        hits = known[word] = terms_in(word)
                    row[hits] = 1.0
            parts.append(weights @ present.T)
        return np.concatenate(parts, axis=1).astype(float)

    return score


def _terms_of(some: pd.DataFrame) -> Score:
    vocabulary = sorted({term for terms in some["terms"] for term in terms})
    place = {term: i for i, term in enumerate(vocabulary)}
    weights = np.zeros((len(some), len(vocabulary)), dtype=np.float32)
    for row, terms in enumerate(some["terms"]):
        for term in terms:
            weights[row, place[term]] += 1
    return _term_scorer(place, weights)


def keyword_search(
    queries: DataFrame, chunks: DataFrame, query_key: str, question: str, chunk_key: str, text: str,
    newest: str, k: int = 5, block: int = TERM_BLOCK,
) -> DataFrame:
    """Chunks holding most of a question's terms; a question without terms, or NULL, gets the newest chunks."""
    types = f"query_id {_type(queries, query_key)}, chunk_id {_type(chunks, chunk_key)}"
    terms = F.coalesce(question_terms(F.col(question)), F.array().cast("array<string>"))
    asked = queries.select(F.col(query_key).alias("q"), terms.alias("terms"))
    lowered = chunks.select(F.col(chunk_key), F.lower(text).alias("_low"))
    found = _scan(asked.filter(F.size("terms") > 0), lowered, chunk_key, "_low", k, block, _terms_of, types + ", score double", 0.0)
    silent = asked.filter(F.size("terms") == 0).select(F.col("q").alias("query_id"))
    latest = chunks.orderBy(F.desc(newest), chunk_key).limit(k).select(F.col(chunk_key).alias("chunk_id"), F.lit(0.0).alias("score"))
    newest_k = latest.agg(F.collect_list(F.struct("chunk_id", "score"))).scalar()
    return _merge(found.unionByName(silent.withColumn("c", newest_k).select("query_id", F.inline("c"))), k)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def context_assembly(
    hits: DataFrame, chunks: DataFrame, chunk_key: str, filename: str, text: str, max_chars: int = CONTEXT_CHARS
) -> DataFrame:
    """Per query: the numbered texts in rank order joined by a rule, and their sources."""
    named = chunks.select(F.col(chunk_key).alias("chunk_id"), F.col(filename).alias("_file"), F.col(text).alias("_text"))
    rows = named.join(hits, "chunk_id")
    part = F.concat(
        F.lit("[Document "), F.col("rank").cast("string"), F.lit(" - "), F.coalesce("_file", F.lit("Unknown")),
        F.lit(" (relevance: "), F.format_number(round_to(F.col("score"), 2), 2), F.lit(")]:\n"),
        F.left("_text", F.lit(max_chars)),
    )
    source = F.concat("_file", F.lit(" "), round_to(F.col("score"), 3).cast("string"))
    # at most k rows per query
    packed = rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", part.alias("part"), source.alias("source")))).alias("x")
    )
    return packed.select(
        "query_id", F.array_join(F.transform("x", lambda s: s["part"]), CONTEXT_RULE).alias("context"),
        F.transform("x", lambda s: s["source"]).alias("sources"),
    )


def hybrid_context(questions: DataFrame, text_answers: DataFrame, data_answers: DataFrame, key: str) -> DataFrame:
    """Document and data answers side by side for each question."""
    both = questions.join(text_answers, key, "left").join(data_answers, key, "left")
    document = F.when(F.col("text_answer") != "", F.concat(F.lit("**Document Context:**\n"), "text_answer", F.lit("\n\n")))
    data = F.when(F.col("data_answer") != "", F.concat(F.lit("**Data Analysis:**\n"), "data_answer"))
    joined = F.concat(F.coalesce(document, F.lit("")), F.coalesce(data, F.lit("")))
    none = "Could not find relevant information from documents or data."
    return both.select(key, F.when(joined == "", none).otherwise(joined).alias("answer"))
