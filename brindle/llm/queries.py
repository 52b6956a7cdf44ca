"""Registered queries of the subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import exact, framed, htmltext, langid, licenses, linejoin, minhash, mixing, neighbours, packing, shallot, slices, warc
from brindle.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


LOWERED = f"translate(coalesce(text, ''), '{exact.UPPER}', '{exact.LOWER}')"


@query("op5_exact_dedup", f"""
WITH low AS (SELECT doc_id, {LOWERED} AS low FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(low) AS text_sha256
FROM low WINDOW w AS (PARTITION BY low)""")
def _(spark, folder):
    return exact.exact_duplicates(table(spark, folder, "documents"))


@query("op1_framed_tokens")
def _(spark, folder):
    out = fresh_path(spark, "records")
    return framed.read_digests(framed.write_records(table(spark, folder, "documents"), out), out)


@query("op8_pack_documents")
def _(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op10_language_id")
def _(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query("op7_html_text")
def _(spark, folder):
    return htmltext.extract_pages(table(spark, folder, "pages"))


@query("op9_mix_sources")
def _(spark, folder):
    return mixing.mix_report(table(spark, folder, "documents"))


@query("op3_minhash")
def _(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle=4)


def _license_sql() -> str:
    """Sentences as rows, joined to the known ones, their signs put together again per document."""
    known = ", ".join(f"('{s}', '{sign}')" for s, sign in licenses.known_plain().items())
    signs = dict(zip(licenses.SENTENCES, licenses.known_plain().values()))
    left, counts = "signs", []
    for rule, license_, parts in licenses.RULES:
        sequence = "".join(signs[p] for p in parts)
        counts.append(f"SELECT doc_id, n_known, '{license_}' AS license, '{rule}' AS rule, "
                      f"CAST((length({left}) - length(replace({left}, '{sequence}', ''))) / {len(parts)} AS BIGINT) AS n_matches FROM per_doc")
        left = f"replace({left}, '{sequence}', '{licenses.USED}')"

    def plain(x):
        letters = rf"trim(regexp_replace(lower({x}), '{licenses.NOT_WORD}', ' ', 'g'))"
        return f"regexp_replace({letters}, '{licenses.HOLDER}', '{licenses.ANY_HOLDER}')"

    return rf"""
WITH known(sentence, sign) AS (VALUES {known}),
cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{licenses.HOLDER_POINT}', '\1', 'g'), '([.!?])\s+|\n\s*\n', '\1' || chr(30), 'g'), chr(30)) AS parts FROM documents),
whole AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
named AS (SELECT doc_id, i, part, sign FROM whole LEFT JOIN known ON sentence = {plain('part')}),
line AS (SELECT doc_id, i, unnest(string_split(part, chr(10))) AS part, generate_subscripts(string_split(part, chr(10)), 1) AS j
         FROM named WHERE sign IS NULL AND contains(part, chr(10))),
hit AS (SELECT doc_id, i, 0 AS j, sign FROM named WHERE sign IS NOT NULL
        UNION ALL SELECT doc_id, i, j, known.sign FROM line JOIN known ON sentence = {plain('part')}),
per_doc AS (SELECT doc_id, string_agg(sign, '' ORDER BY i, j) AS signs, count(*) AS n_known FROM hit GROUP BY doc_id)
SELECT doc_id, license, rule, n_matches, n_known FROM ({' UNION ALL '.join(counts)}) WHERE n_matches > 0"""


@query("op4_license_rules", _license_sql())
def _(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query("op2_line_dedup")
def _(spark, folder):
    return linejoin.removed_lines(linejoin.line_matches(table(spark, folder, "documents")))


@query("op6_nearest_neighbours")
def _(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0"
# Grid coordinates as doubles: whole numbers far below 2^53, so that dot products of them are exact.
ON_GRID = "list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))"
APART = "list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v)"


def _mean(sums: str, n: str) -> str:
    """Floor of a quotient of whole numbers."""
    return f"(({sums}) - ((({sums}) % ({n})) + ({n})) % ({n})) // ({n})"


def _centroid_sql() -> str:
    """The rounds one after another, every vector against every centroid."""
    steps = [f"""
kept AS MATERIALIZED (SELECT vec_id, {ON_GRID} AS v FROM embeddings WHERE len(embedding) = 64 AND {FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8)"""]
    for r in range(11):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT x.vec_id, any_value(x.v) AS v, min(ROW({APART}, c.c)) AS best FROM kept x, c{r} c GROUP BY x.vec_id)""")
        if r < 10:
            steps.append(f"""
m{r} AS (SELECT c, i, {_mean('sum(CAST(x AS HUGEINT))', 'count(*)')} AS x FROM (
         SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
n{r} AS (SELECT c, list(CAST(x AS DOUBLE) ORDER BY i) AS v FROM m{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN n{r} n ON n.c = o.c)""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
       CAST(sum(CAST(best[1] AS BIGINT)) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(CAST(best[1] AS BIGINT)) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a10 JOIN c10 c ON c.c = best[2]"""


def _codes_sql() -> str:
    """The rounds one after another, every part against every entry of its codebook."""
    steps = [f"""
kept AS (SELECT vec_id, label, {ON_GRID} AS v FROM embeddings WHERE {FINITE}),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM kept, range(4) t(p)),
c0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, v FROM parts
                    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"""]
    for r in range(5):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT x.vec_id, any_value(x.label) AS label, x.p, any_value(x.v) AS v, min(ROW({APART}, c.e)) AS best
                      FROM parts x JOIN c{r} c ON c.p = x.p GROUP BY x.vec_id, x.p)""")
        if r < 4:
            steps.append(f"""
m{r} AS (SELECT p, e, i, {_mean('sum(CAST(x AS HUGEINT))', 'count(*)')} AS x FROM (
         SELECT p, best[2] AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, e, i),
n{r} AS (SELECT p, e, list(CAST(x AS DOUBLE) ORDER BY i) AS v FROM m{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN n{r} n ON n.p = o.p AND n.e = o.e)""")
    return f"""WITH {",".join(steps)},
per AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(best[2] AS INTEGER)), '' ORDER BY p) AS code,
               CAST(sum(CAST(best[1] AS BIGINT)) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS sha FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha FROM books) AS codebooks_sha256
FROM per"""


# base32 by 20 bits at a time: five hexadecimal digits give four letters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query("op11_warc_chunks", f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
numbered AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS INTEGER)) AS twenties,
                    row_number() OVER (w ORDER BY page_id NULLS LAST) AS nth, first_value(page_id) OVER (w ORDER BY page_id NULLS LAST) AS head
             FROM hashed WINDOW w AS (PARTITION BY payload))
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(twenties, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('{ALPHABET}', ((n >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE nth WHEN 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN head END AS refers_to
FROM numbered""")
def _(spark, folder):
    return warc.report(table(spark, folder, "pages"), fresh_path(spark, "archives"))


@query("op12_vector_codes", _codes_sql())
def _(spark, folder):
    return slices.report(table(spark, folder, "embeddings"))


@query("op13_centroids", _centroid_sql())
def _(spark, folder):
    return shallot.report(table(spark, folder, "embeddings"))
