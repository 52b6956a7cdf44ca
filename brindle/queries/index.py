"""The persisted vector index: search, refresh, metrics and its quality against exact search.

Where all buckets are probed the index gives what exact search gives, so SQL can check it; searches in few buckets are compared with exact
search in tests and measured by ``index_quality``.
"""

from pyspark.sql import functions as F

from brindle.functions.numbers import round_to
from brindle.operators import vector_index as I
from brindle.operators.search import vector_search
from brindle.queries import query, rd
from brindle.queries.retrieval import HITS, pairs
from brindle.session import fresh_path
from brindle.streaming import jobs as J

# Buckets of two small tables, few enough to probe all of them.
SMALL = {"tables": 2, "bits": 3}
ALL = 8


def _index(t, rows=None, metric="cosine", **options):
    path = fresh_path(t.spark, "vector-index")
    I.create(t.wide("embeddings", "vec_id") if rows is None else rows, path, "vec_id", "embedding", ["label"], metric, **options)
    return path


def _hits(t, path, k=5, probes=I.PROBES, **options):
    hits = I.search(t.embeddings, path, "vec_id", "embedding", "vec_id", k, probes, **options)
    return hits.withColumn("score", round_to(F.col("score"), 6))


@query("vector_index_search")
def _(t):
    """The five nearest vectors of every vector, from the buckets that a search probes by default."""
    return _hits(t, _index(t))


@query("vector_index_exact", f"{pairs()} {HITS} 5")
def _(t):
    return _hits(t, _index(t, **SMALL), probes=ALL)


@query("vector_index_filter", f"{pairs('b.label IN (1, 2)')} {HITS} 5")
def _(t):
    return _hits(t, _index(t, **SMALL), probes=ALL, where=F.col("label").isin(1, 2))


@query("vector_index_metrics", f"""
SELECT metric, query_id, chunk_id, round(score, 4) AS score, rank FROM (SELECT 'euclidean' AS metric, * FROM ({pairs(score='round(-list_distance(a.v, b.v), 9)')} {HITS} 3)
UNION ALL SELECT 'dot_product' AS metric, * FROM ({pairs(score='round(list_dot_product(a.v, b.v), 9)')} {HITS} 3))""")
def _(t):
    """Metrics other than cosine; the search reads the metric from the index."""
    out = None
    for metric in ("euclidean", "dot_product"):
        hits = _hits(t, _index(t, metric=metric, **SMALL), 3, ALL)
        part = hits.select(F.lit(metric).alias("metric"), "query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")
        out = part if out is None else out.unionByName(part)
    return out


@query("vector_index_refresh", f"{pairs()} {HITS} 3")
def _(t):
    """An index made of the vectors with a label below 5, the rest added by a triggered sync."""
    later = fresh_path(t.spark, "arrivals")
    first = F.coalesce(F.col("label") < 5, F.lit(False))
    t.embeddings.filter(~first).write.parquet(later)
    path = _index(t, t.embeddings.filter(first), **SMALL)
    stream = J.file_stream(t.spark, later, t.embeddings.schema)
    I.refresh(stream, path, fresh_path(t.spark, "vector-index-log"), "vec_id", "embedding", ["label"])
    return _hits(t, path, 3, ALL)


@query("vector_index_buckets", "SELECT label, count(*) * 2 AS placed, count(DISTINCT vec_id) AS vectors FROM embeddings GROUP BY label")
def _(t):
    """Every vector is in one bucket of every table."""
    placed = I.read_part(t.spark, _index(t, **SMALL), "buckets")
    return placed.groupBy("label").agg(F.count("*").alias("placed"), F.countDistinct("vec_id").alias("vectors"))


@query("index_quality")
def _(t):
    """Recall and distance ratio of the index over 200 sampled vectors, for 5 and 10 nearest and several numbers of probes."""
    return I.quality(t.wide("embeddings", "vec_id"), _index(t), "vec_id", "embedding")


SAMPLED = "SELECT vec_id FROM embeddings ORDER BY md5('5:' || vec_id), vec_id LIMIT 200"


@query("index_quality_exact", f"{pairs(f'a.vec_id IN ({SAMPLED})')} {HITS} 10")
def _(t):
    """The exact side of ``index_quality``: the ten nearest of the sampled vectors."""
    asked = I.sampled(t.embeddings, "vec_id", 200, 5)
    hits = vector_search(asked, t.wide("embeddings", "vec_id"), "vec_id", "embedding", "vec_id", "embedding", 10)
    return hits.withColumn("score", round_to(F.col("score"), 6))


