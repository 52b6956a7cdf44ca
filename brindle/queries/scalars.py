"""Scalar functions over whole columns."""

from pyspark.sql import functions as F

from brindle.functions import numbers as N
from brindle.functions import text as X
from brindle.functions import vectors as V
from brindle.operators.stats import data_fingerprint
from brindle.queries import query, rd

WS = X.WHITESPACE


def ws_sql(expression: str, template: str) -> str:
    return template.replace("@", expression)


CLEAN = f"regexp_replace(regexp_replace(@, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')"
TERMS = f"list_filter(string_split_regex(lower(@), '{WS}+'), lambda w: length(w) > 2)"


@query("clean_whitespace", f"SELECT doc_id, md5({ws_sql('text', CLEAN)}) AS clean_md5, length({ws_sql('text', CLEAN)}) AS chars FROM documents")
def _(t):
    clean = X.clean_whitespace(F.col("text"))
    return t.documents.select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("bigint").alias("chars"))


@query("question_terms", f"SELECT conv_id, turn, array_to_string({ws_sql('text', TERMS)}, '|') AS terms FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(X.question_terms(F.col("text")), "|").alias("terms"))


LIKE_TERMS = ("the", "and", "une", "der", "para", "zzz")


@query("like_score", f"SELECT doc_id, CAST({' + '.join(f'CAST(contains(lower(text), {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in LIKE_TERMS)} AS INTEGER) AS score FROM documents")
def _(t):
    return t.documents.select("doc_id", X.like_score(F.col("text"), F.array(*[F.lit(w) for w in LIKE_TERMS])).alias("score"))


@query("title_case", """
SELECT p_partkey, array_to_string(list_transform(string_split(replace(replace(p_name, ' ', '_'), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part""")
def _(t):
    return t.part.select("p_partkey", X.title_case(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title"))


@query("number_format", """
SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS price, format('{:,.2f}', CAST(o_custkey AS DOUBLE)) AS plain, '$' || format('{:,.2f}', o_totalprice) AS charge, format('{:,.1f}', CAST(o_custkey AS DOUBLE)) || ' months' AS tenure FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", X.money_or_plain("avg_price", F.col("o_totalprice")).alias("price"),
        X.money_or_plain("avg_key", F.col("o_custkey")).alias("plain"),
        X.answer_number("monthly_charges", F.col("o_totalprice")).alias("charge"),
        X.answer_number("tenure_months", F.col("o_custkey")).alias("tenure"),
    )


@query("extract_json_block", """
SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE props END AS block FROM events""")
def _(t):
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Plan:\n```json\n"), "props", F.lit("\n``` done {x")))
        .when(k == 2, F.concat(F.lit("so "), "props", F.lit(" it is")))
        .when(k == 3, F.concat(F.lit("```\n"), "props", F.lit("```"))).otherwise(F.concat("event_type", F.lit(" {broken")))
    )
    return t.events.select("event_id", X.json_block(text).alias("block"))


LONG = "This is the part of the reply that answers what was asked: "


@query("extract_response_text", f"""
SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN text || chr(10) || chr(10) || 'end' WHEN 4 THEN '{LONG}' || replace(text, chr(10), ' ') ELSE text END AS answer FROM conversations""")
def _(t):
    k, text = F.col("turn") % 5, F.col("text")

    def content(value):
        return F.to_json(F.struct(F.array(F.struct(F.struct(value.alias("content")).alias("message"))).alias("choices")))

    def summary(*parts):
        return F.array(F.struct(F.array(*[F.struct(p.alias("text")) for p in parts]).alias("summary")))

    noted = F.concat(F.lit(LONG), F.replace(text, F.lit("\n"), F.lit(" ")))
    body = (
        F.when(k == 0, content(text))
        .when(k == 1, F.to_json(F.struct(F.array(text).alias("predictions"))))
        .when(k == 2, content(F.array(F.struct(text.alias("text")))))
        .when(k == 3, content(summary(text, F.lit("end"))))
        .otherwise(content(summary(F.lit("We need to answer: short"), F.lit("Let's gather the facts and think about them for a good while"), noted)))
    )
    return t.conversations.select("conv_id", "turn", X.response_text(body).alias("answer"))


@query("date_math", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 90, '%Y-%m-%d') AS since, strftime(o_orderdate, '%Y-%m') AS data_month FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", F.date_format(F.date_sub("o_orderdate", 90), "yyyy-MM-dd").alias("since"),
        F.date_format("o_orderdate", "yyyy-MM").alias("data_month"),
    )


@query("rounding_clip", f"SELECT event_id, {rd('value', 1)} AS rounded, {rd('least(greatest(value / 200 - 0.5, 0.0), 1.0)', 3)} AS clipped FROM events")
def _(t):
    return t.events.select(
        "event_id", N.round_to(F.col("value"), 1).alias("rounded"), N.round_to(N.clip(F.col("value") / 200 - 0.5, 0.0, 1.0), 3).alias("clipped")
    )


@query("risk_level", """
SELECT CASE WHEN l_discount * 10 >= 0.7 THEN 'HIGH' WHEN l_discount * 10 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level,
 CASE WHEN l_discount * 10 >= 0.7 THEN '""" + N.RECOMMENDATIONS["HIGH"] + "' WHEN l_discount * 10 >= 0.4 THEN '" + N.RECOMMENDATIONS["MEDIUM"] + "' ELSE '" + N.RECOMMENDATIONS["LOW"] + "' END AS advice, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    level = N.risk_level(F.col("l_discount") * 10)
    return t.lineitem.groupBy(level.alias("level"), N.recommendation(level).alias("advice")).agg(F.count("*").alias("n"))


@query("rate_band", "SELECT CASE WHEN l_quantity >= 30 THEN 'high' WHEN l_quantity >= 20 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(N.rate_band(F.col("l_quantity")).alias("band")).agg(F.count("*").alias("n"))


@query("severity_z", "SELECT CASE WHEN l_quantity / 10 > 4 THEN 'high' WHEN l_quantity / 10 > 3.5 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(N.severity_z(F.col("l_quantity") / 10).alias("severity")).agg(F.count("*").alias("n"))


@query("severity_if", "SELECT CASE WHEN l_tax - 0.35 < -0.3 THEN 'high' WHEN l_tax - 0.15 < -0.1 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    score = F.when(F.col("l_tax") - 0.35 < -0.3, F.lit(-0.4)).otherwise(F.col("l_tax") - 0.15)
    return t.lineitem.groupBy(N.severity_forest(score).alias("severity")).agg(F.count("*").alias("n"))


DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("cosine_similarity", f"""
WITH d AS (SELECT vec_id, label, {DOUBLES} AS v FROM embeddings)
SELECT vec_id, CASE WHEN label = 0 THEN 0.0 ELSE {rd('list_cosine_similarity(v, list_reverse(v))', 6)} END AS similarity FROM d""")
def _(t):
    other = F.when(F.col("label") != 0, F.reverse("embedding")).otherwise(F.slice("embedding", 1, 3))
    return t.embeddings.select("vec_id", N.round_to(V.cosine(F.col("embedding"), other), 6).alias("similarity"))


@query("normalize_vector", f"""
WITH d AS (SELECT vec_id, {DOUBLES} AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS length FROM d)
SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(CAST(round(CAST(x / length AS DECIMAL(38,8)), 4) AS DECIMAL(10,4)) AS VARCHAR)), ',') AS unit FROM n""")
def _(t):
    shown = F.transform(V.unit(F.col("embedding")), lambda x: F.round(x.cast("decimal(38,8)"), 4).cast("decimal(10,4)").cast("string"))
    return t.embeddings.select("vec_id", F.array_join(shown, ",").alias("unit"))


@query("parse_vector", "SELECT vec_id, CASE WHEN vec_id % 5 IN (3, 4) THEN NULL ELSE len(embedding) END AS dimensions, CASE WHEN vec_id % 5 IN (3, 4) THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS first FROM embeddings")
def _(t):
    k = F.col("vec_id") % 5
    doubles = F.col("embedding").cast("array<double>")
    text = F.when(k == 3, "not a vector").when(k == 4, "[1, x]").otherwise(F.to_json(doubles))
    v = V.parse_vector(text)
    return t.embeddings.select("vec_id", v.alias("v")).select("vec_id", F.when(F.col("v").isNotNull(), F.size("v").cast("bigint")).alias("dimensions"), F.try_element_at("v", F.lit(1)).alias("first"))


def hash_sql(text: str, size: int = 384) -> str:
    """SQL list of the hash embedding: the digest as a 128-bit number, divided by powers of two."""
    half = "CAST(('0x' || substr(d, {0}, 16)) AS UBIGINT)::UHUGEINT"
    number = f"list_transform([md5({text})], lambda d: {half.format(1)} * 18446744073709551616::UHUGEINT + {half.format(17)})"
    powers = "[" + ", ".join(f"{2**i}::UHUGEINT" for i in range(128)) + "]"
    hashed = f"list_transform({number}, lambda h: list_transform({powers}, lambda p: CAST((h // p) % 1000 AS DOUBLE) / 1000))[1]"
    return f"list_concat({hashed}, list_transform(range(0, {size - 128}), lambda i: 0.0::DOUBLE))"


@query("hash_embedding", f"""
WITH e AS (SELECT p_partkey, {hash_sql('p_name || p_partkey')} AS v FROM part)
SELECT p_partkey, len(v) AS dimensions, {rd('list_sum(v)', 3)} AS total, v[1] AS first, v[33] AS second, v[65] AS third, v[128] AS last, {rd('list_sum(list_transform(v, lambda x, i: x * i))', 3)} AS weighted FROM e""")
def _(t):
    v = V.hash_embedding(F.concat("p_name", F.col("p_partkey").cast("string")))
    e = t.wide("part", "p_partkey").select("p_partkey", v.alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select(
        "p_partkey", F.size("v").cast("bigint").alias("dimensions"), N.round_to(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"),
        F.element_at("v", 1).alias("first"), F.element_at("v", 33).alias("second"), F.element_at("v", 65).alias("third"),
        F.element_at("v", 128).alias("last"), N.round_to(weighted, 3).alias("weighted"),
    )


@query("data_fingerprint", """
SELECT left(md5(sum(CAST(('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority), 1, 15)) AS BIGINT)::HUGEINT)::VARCHAR || ':' || count(*)), 8) AS fingerprint FROM orders""")
def _(t):
    return data_fingerprint(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("map_metadata", "SELECT doc_id, 'upload' AS source, CAST(doc_id AS VARCHAR) AS meta_doc FROM documents")
def _(t):
    tagged = t.documents.select(
        "doc_id", F.create_map(F.lit("source"), F.lit("upload"), F.lit("doc_id"), F.col("doc_id").cast("string")).alias("metadata")
    )
    return tagged.select("doc_id", F.element_at("metadata", "source").alias("source"), F.element_at("metadata", "doc_id").alias("meta_doc"))
