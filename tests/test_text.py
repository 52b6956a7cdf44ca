"""Chunking, search, vectors, screens and embedded JSON against plain Python."""

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.functions import vectors as V
from brindle.functions.predicates import injection_verdict
from brindle.operators import chunks as C
from brindle.operators import questions as Q
from brindle.operators import search as R

FOLDER = "/root/testdata/sf0.001"


def walk(words, size, overlap):
    """Chunk word by word."""
    at, out = 0, []
    while at < len(words):
        start, used = at, 0
        while at < len(words) and used < size:
            used += len(words[at]) + 1
            at += 1
        out.append(" ".join(words[start:at]))
        if at < len(words):
            at = max(at - overlap, start + 1) if at - overlap > start else at
    return out


def test_word_chunks_on_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {}
    for r in C.chunk_words(docs, ["doc_id"], "text").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    for r in docs.collect():
        assert got.get(r["doc_id"], []) == walk(r["text"].split(), 512, 50)


def test_long_words_do_not_stop_progress():
    words = ["w" * 600] * 5
    assert C.word_spans(words, 512, 50) == [(i, i + 1) for i in range(5)]
    assert C.word_spans([], 512, 50) == []


def pack(text, size):
    """Sentence packing as a fold over tagged pieces: a long sentence is a break followed by its words."""
    def pieces():
        for sentence in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", text))):
            if len(sentence) <= size:
                yield "sentence", sentence
            else:
                yield "break", ""
                yield from (("word", w) for w in sentence.split())

    groups, cost = [[]], 0
    for kind, piece in pieces():
        fresh = kind == "break" or (kind == "sentence" and cost + len(piece) + 1 > size)
        if fresh:
            groups.append([])
            cost = -1 if kind == "sentence" else 0
        if kind != "break":
            groups[-1].append(piece)
            cost += len(piece) + 1
        if kind == "word" and cost >= size:
            groups.append([])
            cost = 0
    return [" ".join(g) for g in groups if g]


@pytest.mark.parametrize("size", [40, 120, 512])
def test_sentence_chunks_on_all_documents(spark, size):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {}
    for r in C.chunk_sentences(docs, ["doc_id"], "text", size).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    for r in docs.collect():
        assert got.get(r["doc_id"], []) == pack(r["text"], size)


def test_hash_embedding(spark):
    texts = ["", "a", "héé", "longer text " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, v in df.select("t", V.hash_embedding(F.col("t"))).collect():
        h = int(hashlib.md5(t.encode()).hexdigest(), 16)
        assert v == [(h >> i) % 1000 / 1000.0 for i in range(384)]


def test_vector_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([], [1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert np.allclose([r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()], [1, 0, 0, 0, -1])
    assert df.select(V.unit(F.col("a"))).collect()[3][0] == [0.0, 0.0]
    text = spark.createDataFrame([("[1, 2.5]",), ("[1, x]",), ("no",), (None,)], "t string")
    assert [r[0] for r in text.select(V.parse_vector(F.col("t"))).collect()] == [[1.0, 2.5], None, None, None]


@pytest.mark.parametrize("held", [R.HELD_QUESTIONS, 4])
@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_vector_search_with_ties_and_odd_rows(spark, monkeypatch, metric, held):
    """With ``held`` 4 the second and third block of questions leave with every batch."""
    monkeypatch.setattr(R, "HELD_QUESTIONS", held)
    rng = np.random.default_rng(5)
    vectors = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(120)] + [[0.0] * 4, [1.0, 2.0], []]
    chunks = spark.createDataFrame(list(enumerate(vectors)), "id int, v array<double>").repartition(5)
    asked = [(f"q{i}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(9)]
    queries = spark.createDataFrame(asked, "q string, v array<double>")
    hits = R.vector_search(queries, chunks, "q", "v", "id", "v", k=7, metric=metric, block=4)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for name, q in asked:
        scored = []
        for i, v in enumerate(vectors):
            if len(v) != 4:
                if metric == "cosine":
                    scored.append((0.0, i))
                continue
            a, b = np.array(q), np.array(v)
            norms = np.linalg.norm(a) * np.linalg.norm(b)
            s = {"cosine": a @ b / norms if norms else 0.0, "euclidean": -np.linalg.norm(a - b), "dot_product": a @ b}[metric]
            scored.append((round(float(s), 9), i))
        best = sorted(scored, key=lambda x: (-x[0], x[1]))[:7]
        assert [i for i, _ in got[name]] == [i for _, i in best]
        assert np.allclose([s for _, s in got[name]], [s for s, _ in best])


@pytest.mark.parametrize("held", [R.HELD_QUESTIONS, 2])
def test_keyword_search(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD_QUESTIONS", held)
    docs = [(1, "alpha beta gamma"), (2, "Alphabet soup"), (3, "nothing"), (4, "beta alpha alpha"), (5, "gammaray")]
    chunks = spark.createDataFrame(docs, "id int, text string")
    queries = spark.createDataFrame([(1, "alpha BETA beta"), (2, "is a"), (3, "absent")], "q int, question string")
    hits = R.keyword_search(queries, chunks, "q", "question", "id", "text", "id", k=2, block=2)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    # a repeated term counts twice; a question without terms gets the newest; no match gives nothing
    assert got == {1: [(1, 3.0), (4, 3.0)], 2: [(4, 0.0), (5, 0.0)]}


def test_json_block(spark):
    rows = [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"b": 2}\n``` y', '{"b": 2}'), ('see {"c": {"d": 3}} ok', '{"c": {"d": 3}}'), ("no json", None)]
    df = spark.createDataFrame(rows, "t string, e string")
    assert all(r[0] == r[1] for r in df.select(X.json_block(F.col("t")), "e").collect())


def test_injection(spark):
    rows = [("fine question", "ok"), ("x; DROP table", "dangerous"), ("a UNION\n SELECT b", "dangerous"), ("1 or 1=1", "dangerous"),
            ("tail -- ", "dangerous"), ("a -- b", "ok"), ("", "empty"), (None, "empty"), ("y" * 10_001, "too_long"), ("or 'a'='a'", "dangerous"),
            ("/* c */", "dangerous"), ("; create", "dangerous")]
    df = spark.createDataFrame(rows, "t string, e string")
    assert [r[0] for r in df.select(injection_verdict(F.col("t"))).collect()] == [e for _, e in rows]


def tagged(spark, text, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return Q.tag_query_spec(df, "t", **options).first()


def test_question_rules(spark):
    assert tagged(spark, "customers not churned")["outcome"] == "negative"
    assert tagged(spark, "customers not churned", compat=True)["outcome"] == "positive"
    assert tagged(spark, "which country")["agg"] is None
    row = tagged(spark, "list top 10 customers")
    assert (row["agg"], row["row_limit"], row["order_term"]) == (None, 10, "total")
    row = tagged(spark, "highest monthly charge")
    assert (row["agg"], row["order_term"], row["agg_term"]) == ("MAX", None, "charge")
    row = tagged(spark, "average tenure of males and females")
    assert (row["gender"], row["group_by"]) == (None, "gender")
    assert tagged(spark, "count of females")["gender"] == "Female"
    assert tagged(spark, "top 5000 by revenue")["row_limit"] == 5000


def test_routes(spark):
    asked = {
        "How many customers have churned?": "data", "What is the attention mechanism?": "knowledge",
        "Compare and analyze the pattern": "hybrid", "hello there": "unknown", "is 5 enough": "data",
    }
    df = spark.createDataFrame([(q,) for q in asked], "t string")
    got = {r["t"]: r["query_type"] for r in Q.route_questions(df, "t").collect()}
    assert got == asked


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_scores_are_made_for_a_bounded_slice_of_chunks(metric, monkeypatch):
    """A worker's memory is that of a block of questions by a slice of chunks, whatever the batches hold."""
    import pandas as pd

    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(5000, 4)).round(1)
    some = pd.DataFrame({"q": range(3), "v": list(vectors[:3])})
    inner, seen = R._vector_scorer(metric, False), []

    def scorer(block):
        score = inner(block)
        return lambda chunks: (seen.append(len(chunks)), score(chunks))[1]

    class Frame:
        """Stands for the question and chunk tables: hands the worker's function its batches."""
        sparkSession = None
        write = type("W", (), {"parquet": staticmethod(lambda path: None)})

        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return pd.concat(run(iter([pd.DataFrame({"c": range(5000), "v": list(vectors)})])))

    monkeypatch.setattr(R, "fresh_path", lambda *a: "")
    monkeypatch.setattr(R, "question_blocks", lambda path, block: iter([some]))
    found = R._scan(Frame(), Frame(), "c", "v", 4, 1024, scorer, "", None if metric == "cosine" else -np.inf)
    assert max(seen) <= R.CHUNK_SLICE and sum(seen) == 5000
    whole = inner(some)(pd.Series(list(vectors)))
    for q in range(3):
        assert list(found[found.query_id == q].chunk_id) == sorted(range(5000), key=lambda i: (-whole[q, i], i))[:4]


def test_heavy_rows_of_one_small_file_go_to_all_cores(spark, tmp_path):
    from brindle import queries as registry

    registry.load_all()
    spark.range(50).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["hash_embedding"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and got.count() == 50


def test_pieces_of_a_batch_leave_in_slices():
    texts = pd.Series(["a b", None, ""] * 100)
    out = list(C.word_cutter().func(iter([texts, texts[:0]])))
    assert [len(part) for part in out] == [128, 128, 44, 0]
    assert [p for part in out for p in part] == [["a b"], [], []] * 100


def test_topk_similarity_looks_beyond_the_vector_itself(spark, tmp_path):
    from brindle import queries as registry

    registry.load_all()
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(40, 6))
    spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in registry.QUERIES["topk_similarity"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i, row in enumerate(unit @ unit.T):
        best = np.argsort(-row)[:5]
        assert got[i] == [(j, pytest.approx(row[j], abs=1e-6)) for j in best]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
@pytest.mark.parametrize("shape", ["random", "far from zero", "all alike"])
def test_single_precision_leaves_few_pairs_and_loses_no_hit(metric, shape, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(4096, 16)) * (1e-4 if shape == "far from zero" else 1) + (5.0 if shape == "far from zero" else 0)
    if shape == "all alike":
        vectors[:] = vectors[0]
    names, asked, pairs = rng.permutation(4096), R._Near(metric, vectors[:40].copy()), []
    inner = R._Near.scores
    monkeypatch.setattr(R._Near, "scores", lambda self, who, other, what: (pairs.append(len(who)), inner(self, who, other, what))[1])
    rows, hits = R._Near(metric, vectors), R._Hits(40, 5, names.dtype)
    near = rows.chunks()
    for lo in range(0, 4096, R.CHUNK_SLICE):
        part = np.arange(lo, lo + R.CHUNK_SLICE)
        R._take(hits, np.arange(40), asked, asked.questions(), rows.some(part), near[part], names[part])
    if shape == "random":
        assert sum(pairs) < 40 * 4096 / 100
    a, b = vectors[:40], vectors
    lengths = np.linalg.norm(b, axis=1)
    whole = {"cosine": lambda: a @ b.T / lengths[:40, None] / lengths, "dot_product": lambda: a @ b.T,
             "euclidean": lambda: -np.stack([np.linalg.norm(b - q, axis=1) for q in a])}[metric]()
    for q, row in enumerate(np.round(whole, R.SCORE_DIGITS)):
        best = sorted(range(4096), key=lambda i: (-row[i], names[i]))[:5]
        assert np.allclose(hits.scores[q], row[best], atol=2e-9, rtol=0)
        if shape != "far from zero":
            assert list(hits.names[q]) == [names[i] for i in best]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_vectors_that_single_precision_cannot_hold(spark, metric):
    odd = [[1e30, 0.0], [1e-30, 0.0], [None, 1.0], None, [0.0, 0.0], [1e40, 1.0]]
    plain = np.random.default_rng(2).normal(size=(30, 2)).tolist()
    rows = list(enumerate(odd + plain))
    table = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    got = {}
    for r in R.vector_search(table, table, "id", "v", "id", "v", 4, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for i, v in rows:
        scored = []
        for j, w in rows:
            whole = v is not None and w is not None and None not in v and None not in w
            if metric == "cosine":
                norms = math.hypot(*v) * math.hypot(*w) if whole else 0.0
                scored.append((round(float(np.dot(v, w)) / norms, 9) if 0 < norms < math.inf else 0.0, j))
            elif whole:
                scored.append((round(float(np.dot(v, w)) if metric == "dot_product" else -math.dist(v, w), 9), j))
        best = sorted(scored, key=lambda x: (-x[0], x[1]))[:4]
        assert [s for _, s in got.get(i, [])] == [pytest.approx(s, rel=1e-12, abs=2e-9) for s, _ in best]
