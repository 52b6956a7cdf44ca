"""Scans, file sources, sinks and table maintenance."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from brindle.functions.text import WHITESPACE
from brindle.operators.schema import billing_defaults, coerce_values, infer_types, lineage_columns, normalize_columns, type_map
from brindle.queries import query, rd
from brindle.session import fresh_path
from brindle.sources import files, tables

DAY = "yyyy-MM-dd"
ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("src_csv", "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def _(t):
    path = fresh_path(t.spark, "documents") + ".csv"
    t.documents.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    raw = files.read_csv(t.spark, path)
    return coerce_values(raw, type_map(infer_types(raw))).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


STYLES = '<styleSheet><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
DAYS_BEFORE = (pd.Timestamp("2020-01-01") - pd.Timestamp("1899-12-30")).days


def _workbook(rows: list[list]) -> bytes:
    """Smallest readable workbook, used only to turn table rows into spreadsheet files."""
    def cell(v):
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, pd.Timedelta):
            return f'<c s="1"><v>{v.days}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    body = "".join(f'<row>{"".join(cell(v) for v in r)}</row>' for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/styles.xml", STYLES)
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _workbooks(t):
    """Customers as workbooks of at most 500 rows below a two-line banner; every second book has its columns turned round."""
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["book"].iloc[0])
        turn = -1 if number % 2 else 1
        rows = [["Customer report"], [2024, 1], ["Key", "Name", "Balance", "Segment", "Since", "Owing"][::turn]]
        for r in pdf.sort_values("c_custkey").itertuples():
            since = pd.Timedelta(days=DAYS_BEFORE + r.c_custkey % 1000)
            rows.append([int(r.c_custkey), r.c_name, float(r.c_acctbal), r.c_mktsegment, since, bool(r.c_acctbal < 0)][::turn])
        return pd.DataFrame({"path": [f"book-{number}.xlsx"], "content": [_workbook(rows)]})

    # few bytes make many workbooks, so their tasks are not put together by what they read
    books = t.customer.withColumn("book", F.floor(F.col("c_custkey") / 500)).repartition(t.spark.sparkContext.defaultParallelism, "book")
    return books.groupBy("book").applyInPandas(write, "path string, content binary")


@query("src_excel", """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
 strftime(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER), '%Y-%m-%d %H:%M:%S') AS since, CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END AS owing FROM customer""")
def _(t):
    raw = normalize_columns(files.sheet_table(files.sheet_rows(_workbooks(t))))
    raw = raw.withColumnRenamed("col_key", "key")
    return coerce_values(raw, type_map(infer_types(raw)))


@query("src_header_detect", "SELECT DISTINCT 'book-' || CAST(floor(c_custkey / 500) AS BIGINT) || '.xlsx' AS path, CAST(2 AS BIGINT) AS header_row FROM customer")
def _(t):
    return files.header_rows(files.sheet_rows(_workbooks(t)))


@query("src_text_docs", f"""
SELECT 'doc-' || doc_id AS path, md5(text) AS text_md5, length(text) AS chars FROM documents
WHERE regexp_replace(text, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g') <> ''""")
def _(t):
    narrow = (F.col("lang") == "fr") & F.col("text").rlike(r"^[\x00-\xFF]*$")
    content = F.when(narrow, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    uploads = t.documents.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"))
    return files.text_documents(uploads).select("path", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


SCAN_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("scan_recent", f"""
SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem ORDER BY l_shipdate DESC, {', '.join(SCAN_TIES)} LIMIT 1000""")
def _(t):
    return tables.recent(t.lineitem, "l_shipdate", SCAN_TIES).select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", DAY).alias("shipped")
    )


@query("scan_billing", f"""
SELECT l_suppkey, l_partkey, l_returnflag, l_linestatus, l_extendedprice, l_quantity, l_tax, l_orderkey FROM lineitem WHERE l_tax > 0
ORDER BY l_shipdate DESC, {', '.join(SCAN_TIES)} LIMIT 1000""")
def _(t):
    return tables.recent(t.lineitem.filter("l_tax > 0"), "l_shipdate", SCAN_TIES).select(
        "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "l_tax", "l_orderkey"
    )


@query("scan_chunks", "SELECT vec_id, label, len(embedding) AS dimensions FROM embeddings WHERE label <> 3")
def _(t):
    holes = t.embeddings.withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding")))
    return holes.filter(F.col("embedding").isNotNull()).select("vec_id", "label", F.size("embedding").cast("bigint").alias("dimensions"))


@query("describe_schema", """
SELECT * FROM (SELECT 'o_orderkey' AS "column", 'BIGINT' AS type, count(o_orderkey) AS filled FROM orders UNION ALL SELECT 'o_custkey', 'BIGINT', count(o_custkey) FROM orders
 UNION ALL SELECT 'o_orderstatus', 'STRING', count(o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice', 'DOUBLE', count(o_totalprice) FROM orders
 UNION ALL SELECT 'o_orderdate', 'TIMESTAMP_NTZ', count(o_orderdate) FROM orders UNION ALL SELECT 'o_orderpriority', 'STRING', count(o_orderpriority) FROM orders)""")
def _(t):
    filled = t.orders.agg(*[F.count(c).alias(c) for c in t.orders.columns])
    tall = filled.unpivot([], filled.columns, "column", "filled")
    return tables.describe(t.orders).join(tall, "column")


@query("preview", "SELECT doc_id, source, left(text, 100) AS preview FROM documents ORDER BY doc_id LIMIT 20")
def _(t):
    return tables.preview(t.documents, "doc_id", "source", "text")


ADMIT = "replace(name, '..', '')"


@query("file_admission", f"""
WITH f AS (SELECT 'page' AS kind, page_id AS k, url AS name, strlen(html) AS size FROM pages
  UNION ALL SELECT 'doc', doc_id, CASE WHEN doc_id % 4 = 0 THEN '../' || source || '.TXT' WHEN doc_id % 4 = 1 THEN source || '.exe' WHEN doc_id % 4 = 2 THEN '' ELSE repeat(source, 100) || '.pdf' END, n_chars FROM documents),
s AS (SELECT *, replace(replace({ADMIT}, '/', '_'), '\\', '_') AS safe FROM f),
v AS (SELECT *, CASE WHEN name = '' THEN 'no_name' WHEN length(name) > 255 THEN 'name_too_long' WHEN size > 20000 THEN 'too_large'
  WHEN lower(regexp_extract(safe, '\\.[^.]*$')) NOT IN ('.pdf', '.txt') THEN 'bad_type' ELSE 'ok' END AS verdict FROM s)
SELECT kind, k, verdict, CASE WHEN verdict = 'ok' THEN safe END AS safe_name FROM v""")
def _(t):
    k = F.col("doc_id") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("../"), "source", F.lit(".TXT"))).when(k == 1, F.concat("source", F.lit(".exe")))
        .when(k == 2, "").otherwise(F.concat(F.repeat("source", F.lit(100)), F.lit(".pdf")))
    )
    manifest = t.pages.select(
        F.lit("page").alias("kind"), F.col("page_id").alias("k"), F.col("url").alias("name"), F.octet_length("html").cast("bigint").alias("size")
    ).unionByName(t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("k"), name.alias("name"), F.col("n_chars").alias("size")))
    judged = manifest.select("kind", "k", files.admission(F.col("name"), F.col("size"), max_bytes=20000).alias("a"))
    return judged.select("kind", "k", "a.*")


@query("sink_create", f"SELECT count(*) AS n, {rd('sum(o_totalprice)', 2)} AS total, 8 AS columns FROM orders")
def _(t):
    path = fresh_path(t.spark, "accounts")
    upload = _orders(t).toDF("Order Key", "Cust-Key", "Status", "Total.Price", "Priority")
    text = upload.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in upload.columns])
    schema = tables.create_table(text, path)
    rows = lineage_columns(normalize_columns(text), F.lit("orders.csv"))
    tables.append_rows(rows, path, schema)
    stored = t.spark.read.parquet(path)
    return stored.agg(
        F.count("*").alias("n"), F.round(F.sum("total_price").cast("decimal(38,8)"), 2).cast("double").alias("total"),
        F.lit(len(stored.columns)).alias("columns"),
    )


@query("sink_append", """
SELECT o_orderkey % 9 = 4 AS refused, count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    path = fresh_path(t.spark, "appended")
    upload = t.orders.select(
        F.when(F.col("o_orderkey") % 9 != 4, F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_totalprice").cast("string").alias("price"),
    )
    schema = tables.T.StructType([
        tables.T.StructField("id", tables.T.StringType()), tables.T.StructField("price", tables.T.DoubleType()),
    ])
    refused = tables.append_rows(upload, path, schema)
    kept = t.spark.read.schema(schema).parquet(path)
    return kept.agg(F.count("*").alias("n")).select(F.lit(False).alias("refused"), "n").unionByName(
        refused.agg(F.count("*").alias("n")).select(F.lit(True).alias("refused"), "n")
    )


@query("sink_billing", f"""
SELECT strftime(l_shipdate, '%Y-%m') AS data_month, count(*) AS n, {rd('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY 1""")
def _(t):
    path = fresh_path(t.spark, "billing")
    upload = t.lineitem.select(
        "l_shipdate", F.col("l_suppkey").alias("enterprise"), F.col("l_partkey").alias("subaccount"),
        F.col("l_extendedprice").alias("monthly_rate"), F.col("l_quantity").alias("bandwidth"),
    )
    rows = lineage_columns(billing_defaults(upload), F.lit("lineitem"), F.col("l_shipdate"))
    tables.append_billing(rows, path)
    return t.spark.read.parquet(path).groupBy("data_month").agg(
        F.count("*").alias("n"), F.sum("monthly_rate").cast("double").alias("total")
    )


@query("retention_delete", """
SELECT count(*) AS n, strftime(min(l_shipdate), '%Y-%m-%d') AS oldest FROM lineitem
WHERE CAST(l_shipdate AS DATE) >= CAST((SELECT max(l_shipdate) FROM lineitem) AS DATE) - 90""")
def _(t):
    kept = tables.retained(t.lineitem, "l_shipdate", 3, t.lineitem.agg(F.max("l_shipdate")).scalar())
    return kept.agg(F.count("*").alias("n"), F.date_format(F.min("l_shipdate"), DAY).alias("oldest"))


@query("ddl_tables", """
SELECT 'billing' AS table_name, 12 AS columns, count(*) AS n FROM orders UNION ALL SELECT 'chunks', 7, count(*) FROM documents""")
def _(t):
    billing, chunks = fresh_path(t.spark, "ddl-billing"), fresh_path(t.spark, "ddl-chunks")
    t.spark.createDataFrame([], tables.BILLING_SCHEMA).write.parquet(billing)
    t.spark.createDataFrame([], tables.CHUNK_SCHEMA).write.parquet(chunks)
    rows = lineage_columns(
        t.orders.select(F.col("o_custkey").cast("string").alias("enterprise_id"), F.col("o_totalprice").alias("monthly_rate")), F.lit("orders")
    )
    filled = rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in tables.BILLING_SCHEMA
    ])
    filled.write.mode("append").parquet(billing)
    texts = t.documents.select(
        F.col("source").alias("filename"), "text", F.array(F.lit(0.0)).alias("embedding"), F.lit(0).alias("chunk_index"),
        F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string")).alias("metadata"),
    )
    tables.append_chunks(texts, chunks)
    out = []
    for name, path in (("billing", billing), ("chunks", chunks)):
        stored = t.spark.read.parquet(path)
        out.append(stored.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(len(stored.columns)).alias("columns"), "n"))
    return out[0].unionByName(out[1])


@query("index_create", f"""
WITH d AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM d)
SELECT vec_id, label, {rd('norm', 5)} AS norm, len(v) AS dimensions, {rd('v[1] / norm', 5)} AS first_unit, {rd('v[64] / norm', 5)} AS last_unit FROM n""")
def _(t):
    index = tables.index_create(t.embeddings, fresh_path(t.spark, "index"), "vec_id", "embedding", ["label"])
    r = tables.F.round
    return index.select(
        "vec_id", "label", r(F.col("norm").cast("decimal(38,8)"), 5).cast("double").alias("norm"), F.col("dimensions").cast("bigint").alias("dimensions"),
        r(F.element_at("unit_vector", 1).cast("decimal(38,8)"), 5).cast("double").alias("first_unit"),
        r(F.element_at("unit_vector", -1).cast("decimal(38,8)"), 5).cast("double").alias("last_unit"),
    )


@query("index_info", "SELECT count(*) AS vectors, min(len(embedding)) AS min_dimensions, max(len(embedding)) AS max_dimensions, max(vec_id) AS newest_upload FROM embeddings")
def _(t):
    info = tables.index_info(tables.index_table(t.embeddings, "vec_id", "embedding"), "vec_id")
    return info.withColumns({c: F.col(c).cast("bigint") for c in ("min_dimensions", "max_dimensions")})


REQUESTS = """(SELECT event_id AS request_id, CASE event_type WHEN 'view' THEN '/health' ELSE '/' || event_type END AS path,
 CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END AS status_code, value * 1.2345 AS duration_ms FROM events)"""


def requests(events):
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("request_id"), "ts",
        F.when(kind == "view", "/health").otherwise(F.concat(F.lit("/"), kind)).alias("path"),
        F.when(kind == "error", 503).when(kind == "signup", 404).otherwise(200).alias("status_code"),
        (F.col("value") * 1.2345).alias("duration_ms"),
    )


@query("audit_sink", f"""
SELECT request_id, path, status_code, {rd('duration_ms', 2)} AS duration_ms,
 CASE WHEN status_code >= 500 THEN 'error' WHEN status_code >= 400 THEN 'warning' ELSE 'info' END AS severity FROM {REQUESTS} WHERE path <> '/health'""")
def _(t):
    path = fresh_path(t.spark, "audit")
    tables.audit_rows(requests(t.events)).drop("ts").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


