"""Chunking, embedding and retrieval over the document and vector tables."""

from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.functions.numbers import round_to
from brindle.functions.text import WHITESPACE
from brindle.operators import chunks as C
from brindle.operators import search as R
from brindle.queries import query, rd
from brindle.queries.scalars import DOUBLES, TERMS, hash_sql, ws_sql
from brindle.session import fresh_path, written
from brindle.sources import tables

# running lengths per document, then one chunk after the other
CHUNKS = f"""
w AS (SELECT doc_id, source, list_filter(string_split_regex(text, '{WHITESPACE}+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
s AS (SELECT doc_id, i, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM u),
p AS (SELECT s.doc_id, any_value(w.source) AS source, any_value(ws) AS ws, CAST(count(*) AS BIGINT) AS n, list(CAST(upto AS BIGINT) ORDER BY i) AS cum FROM s JOIN w ON s.doc_id = w.doc_id GROUP BY s.doc_id),
c AS (SELECT doc_id, 0 AS chunk_index, CAST(0 AS BIGINT) AS a, least(len(list_filter(cum, lambda x: x < 512)) + 1, n) AS b FROM p
 UNION ALL SELECT c.doc_id, c.chunk_index + 1, nx, least(len(list_filter(cum, lambda x: x < cum[nx] + 512)) + 1, n)
 FROM (SELECT *, CASE WHEN b - 50 > a THEN b - 50 ELSE b END AS nx FROM c) c JOIN p ON p.doc_id = c.doc_id WHERE c.b < p.n),
chunk AS (SELECT c.doc_id, p.source, c.chunk_index, array_to_string(p.ws[a + 1 : b], ' ') AS text FROM c JOIN p ON p.doc_id = c.doc_id)"""


def _chunks(t):
    return C.chunk_corpus(t.wide("documents", "doc_id"), "doc_id", "source", "text")


@query("chunk_words", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index, md5(text) AS chunk_md5, length(text) AS chars FROM chunk")
def _(t):
    out = C.chunk_words(t.wide("documents", "doc_id"), ["doc_id"], "text")
    return out.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("bigint").alias("chars"))


@query("chunk_sentences")
def _(t):
    out = C.chunk_sentences(t.wide("documents", "doc_id"), ["doc_id"], "text")
    return out.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("bigint").alias("chars"))


@query("chunk_corpus", f"WITH RECURSIVE {CHUNKS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS filename, chunk_index, md5(text) AS text_md5, 'upload' AS origin FROM chunk")
def _(t):
    return _chunks(t).select("doc_id", "filename", "chunk_index", F.md5("text").alias("text_md5"), F.element_at("metadata", "source").alias("origin"))


@query("embed_corpus", f"""WITH RECURSIVE {CHUNKS}, e AS (SELECT doc_id, chunk_index, {hash_sql('text')} AS v FROM chunk)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_index, len(v) AS dimensions, {rd('list_sum(v)', 3)} AS total, v[1] AS first, v[100] AS hundredth FROM e""")
def _(t):
    e = _chunks(t).select("doc_id", "chunk_index", V.hash_embedding(F.col("text")).alias("v"))
    return e.select(
        "doc_id", "chunk_index", F.size("v").cast("bigint").alias("dimensions"),
        round_to(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"),
        F.element_at("v", 1).alias("first"), F.element_at("v", 100).alias("hundredth"),
    )


@query("sink_chunks", f"WITH RECURSIVE {CHUNKS} SELECT source AS filename, count(*) AS chunks, count(DISTINCT doc_id) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunk GROUP BY 1")
def _(t):
    path = fresh_path(t.spark, "chunks")
    tables.append_chunks(_chunks(t).withColumn("embedding", V.hash_embedding(F.col("text"))), path)
    return t.spark.read.parquet(path).groupBy("filename").agg(
        F.count("*").alias("chunks"), F.countDistinct(F.element_at("metadata", "doc_id")).alias("documents"), F.sum(F.length("text")).alias("chars")
    )


def _asked(t):
    return t.benchmark.select(F.col("item_id"), "text", V.hash_embedding(F.col("text")).alias("v"))


def _vectors(t):
    """Chunk vectors, written once so that several blocks of queries do not chunk and hash again."""
    keyed = _chunks(t).select(
        F.concat("doc_id", F.lit("-"), F.lpad(F.col("chunk_index").cast("string"), 5, "0")).alias("chunk_key"),
        "filename", "text", V.hash_embedding(F.col("text")).alias("vector"),
    )
    return written(keyed, "chunk-vectors")


KEYED = f"e AS (SELECT doc_id || '-' || lpad(CAST(chunk_index AS VARCHAR), 5, '0') AS chunk_id, source, text, {hash_sql('text')} AS v FROM chunk)"
BEST = f"""WITH RECURSIVE {CHUNKS}, {KEYED}, b AS (SELECT item_id AS query_id, {hash_sql('text')} AS q FROM benchmark),
x AS (SELECT query_id, chunk_id, source, text, round(list_cosine_similarity(q, v), 9) AS score FROM b, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x)"""


@query("vector_search", f"{BEST} SELECT query_id, chunk_id, {rd('score', 6)} AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def _(t):
    hits = R.vector_search(_asked(t), _vectors(t), "item_id", "v", "chunk_key", "vector")
    return hits.withColumn("score", round_to(F.col("score"), 6))


@query("context_assembly", f"""{BEST}
SELECT query_id, md5(string_agg('[Document ' || rank || ' - ' || source || ' (relevance: ' || printf('%.2f', round(CAST(score AS DECIMAL(38,8)), 2)) || ')]:' || chr(10) || left(text, 1500), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5,
 string_agg(source || ' ' || CAST(CAST(round(CAST(score AS DECIMAL(38,8)), 3) AS DOUBLE) AS VARCHAR), '|' ORDER BY rank) AS sources FROM r WHERE rank <= 5 GROUP BY 1""")
def _(t):
    chunks = _vectors(t)
    hits = R.vector_search(_asked(t), chunks, "item_id", "v", "chunk_key", "vector")
    out = R.context_assembly(hits, chunks, "chunk_key", "filename", "text")
    return out.select("query_id", F.md5("context").alias("context_md5"), F.array_join("sources", "|").alias("sources"))


def pairs(where="true", score="round(list_cosine_similarity(a.v, b.v), 9)"):
    return f"""WITH d AS (SELECT vec_id, label, {DOUBLES} AS v FROM embeddings),
x AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {score} AS score FROM d a, d b WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x)"""


def _self(t, **options):
    # all pairs: a scan's parts may hold unlike numbers of rows, whatever their number
    chunks = t.embeddings.repartition(t.spark.sparkContext.defaultParallelism, "vec_id")
    hits = R.vector_search(t.embeddings, chunks, "vec_id", "embedding", "vec_id", "embedding", **options)
    return hits.withColumn("score", round_to(F.col("score"), 6))


HITS = f"SELECT query_id, chunk_id, {rd('score', 6)} AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= "


@query("vector_search_batch", f"{pairs()} {HITS} 5")
def _(t):
    return _self(t)


@query("topk_similarity", f"{pairs()} {HITS} 5")
def _(t):
    """The best of a vector is itself, so one hit would say nothing: five, as the search asks for by default."""
    return _self(t, k=5)


@query("filter_metadata", f"{pairs('b.label IN (1, 2)')} {HITS} 5")
def _(t):
    return _self(t, where=F.col("label").isin(1, 2))


@query("metric_variants", f"""
SELECT metric, query_id, chunk_id, round(score, 4) AS score, rank FROM (SELECT 'euclidean' AS metric, * FROM ({pairs(score='round(-list_distance(a.v, b.v), 9)')} {HITS} 3)
UNION ALL SELECT 'dot_product' AS metric, * FROM ({pairs(score='round(list_dot_product(a.v, b.v), 9)')} {HITS} 3))""")
def _(t):
    out = None
    for metric in ("euclidean", "dot_product"):
        part = _self(t, k=3, metric=metric).select(
            F.lit(metric).alias("metric"), "query_id", "chunk_id", F.round("score", 4).alias("score"), "rank"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("join_query_docs", f"""
WITH d AS (SELECT vec_id, {DOUBLES} AS v FROM embeddings), q AS (SELECT v AS w FROM d ORDER BY vec_id LIMIT 1)
SELECT vec_id, {rd('list_cosine_similarity(w, v)', 6)} AS cosine, {rd('list_distance(w, v)', 6)} AS euclidean, {rd('list_dot_product(w, v)', 6)} AS dot_product FROM d, q""")
def _(t):
    question = t.embeddings.agg(F.min_by("embedding", "vec_id")).scalar()
    asked = t.embeddings.withColumn("w", question)
    return asked.select("vec_id", *[round_to(fn(F.col("w"), F.col("embedding")), 6).alias(name) for name, fn in V.METRICS.items()])


@query("keyword_search", f"""
WITH q AS (SELECT item_id, {ws_sql('text', TERMS)} AS terms FROM benchmark), d AS (SELECT doc_id, lower(text) AS low FROM documents),
x AS (SELECT item_id AS query_id, doc_id AS chunk_id, len(list_filter(terms, lambda w: contains(low, w))) AS score FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x WHERE score > 0)
SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def _(t):
    return R.keyword_search(t.benchmark, t.wide("documents", "doc_id"), "item_id", "text", "doc_id", "text", "doc_id")


@query("join_hybrid_context", """
WITH q AS (SELECT doc_id FROM documents), a AS (SELECT doc_id, text AS x FROM documents WHERE lang = 'en'), b AS (SELECT doc_id, 'toxic ' || toxic AS y FROM labels)
SELECT q.doc_id, md5(CASE WHEN x IS NULL AND y IS NULL THEN 'Could not find relevant information from documents or data.' ELSE
 coalesce('**Document Context:**' || chr(10) || nullif(x, '') || chr(10) || chr(10), '') || coalesce('**Data Analysis:**' || chr(10) || y, '') END) AS answer_md5
FROM q LEFT JOIN a ON a.doc_id = q.doc_id LEFT JOIN b ON b.doc_id = q.doc_id""")
def _(t):
    text = t.documents.filter("lang = 'en'").select("doc_id", F.col("text").alias("text_answer"))
    data = t.labels.select("doc_id", F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("data_answer"))
    out = R.hybrid_context(t.documents.select("doc_id"), text, data, "doc_id")
    return out.select("doc_id", F.md5("answer").alias("answer_md5"))


@query("chunk_table", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index, md5(text) AS chunk_md5 FROM chunk")
def _(t):
    C.register_functions(t.spark)
    return t.spark.sql(
        "SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5 FROM {docs}, LATERAL chunk_table(text)", docs=t.documents
    )


@query("embed_hook", "SELECT item_id, len(string_split(text, ' ')) AS spaces, length(text) AS chars FROM benchmark")
def _(t):
    model = lambda texts: [(float(s.count(" ") + 1), float(len(s))) for s in texts]
    vectors = C.embed(t.benchmark, "text", model)
    return vectors.select("item_id", F.element_at("embedding", 1).cast("bigint").alias("spaces"), F.element_at("embedding", 2).cast("bigint").alias("chars"))
