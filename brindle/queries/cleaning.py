"""Names, types, profiling, imputation and row descriptions."""

from pyspark.sql import functions as F

from brindle.operators import schema as S
from brindle.queries import query, rd


@query("normalize_columns", """
SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_orderstatus AS col_count, o_totalprice AS a_b, o_orderpriority AS a_b_2 FROM orders""")
def _(t):
    messy = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").toDF(
        " Order Key", "order-key", "Count", "a b", "A.B"
    )
    return S.normalize_columns(messy)


IDENT = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-zA-Z0-9_]', '_', 'g'), '^[^a-zA-Z_]', '_')"


@query("sanitize_identifier", f"""
WITH n AS (SELECT 'part' AS source, p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN ' ' || p_name || ' ' WHEN p_size % 4 = 1 THEN 'Select'
  WHEN p_size % 4 = 2 THEN p_size || p_brand ELSE p_type END AS name FROM part
  UNION ALL SELECT 'page', page_id, url FROM pages UNION ALL SELECT 'customer', c_custkey, c_name FROM customer),
s AS (SELECT source, k, name, {IDENT.format('name')} AS safe FROM n)
SELECT source, k, CASE WHEN length(trim(name)) BETWEEN 1 AND 128 THEN
  CASE WHEN safe IN ({', '.join(f"'{w}'" for w in sorted(S.RESERVED_IDENTIFIERS))}) THEN 'col_' || safe ELSE safe END END AS identifier FROM s""")
def _(t):
    k = F.col("p_size") % 4
    name = (
        F.when(k == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k == 1, "Select")
        .when(k == 2, F.concat(F.col("p_size").cast("string"), "p_brand")).otherwise(F.col("p_type"))
    )
    names = (
        t.part.select(F.lit("part").alias("source"), F.col("p_partkey").alias("k"), name.alias("name"))
        .unionByName(t.pages.select(F.lit("page").alias("source"), F.col("page_id").alias("k"), F.col("url").alias("name")))
        .unionByName(t.customer.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))
    )
    return names.select("source", "k", S.sanitize_identifier(F.col("name")).alias("identifier"))


def as_text(t):
    """Orders as an untyped upload: everything text, some values unusable."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k, F.col("o_custkey").cast("string").alias("cust"), F.col("o_totalprice").cast("string").alias("price"),
        F.when(k % 10 == 3, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mostly"),
        F.when(k % 4 == 1, "x").otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
        F.col("o_orderstatus").alias("status"),
        F.when(k % 5 == 2, None).otherwise(F.col("o_totalprice")).alias("gaps"),
        F.col("o_orderdate").alias("ordered"),
    )


UNTYPED = """(SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cust, CAST(o_totalprice AS VARCHAR) AS price,
 CASE WHEN o_orderkey % 10 = 3 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS mostly,
 CASE WHEN o_orderkey % 4 = 1 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS mixed, o_orderstatus AS status FROM orders)"""


def _judge(c):
    return f"""SELECT '{c}' AS "column", CASE WHEN count(TRY_CAST({c} AS DOUBLE)) > 0.8 * count(*) THEN
 CASE WHEN bool_and(coalesce(TRY_CAST({c} AS DOUBLE) % 1 = 0, false)) THEN 'BIGINT' ELSE 'DOUBLE' END ELSE 'STRING' END AS type
 FROM (SELECT {c} FROM {UNTYPED} WHERE {c} IS NOT NULL)"""


@query("infer_types", " UNION ALL ".join(_judge(c) for c in ("cust", "price", "mostly", "mixed", "status")) + """
 UNION ALL SELECT 'o_orderkey', 'BIGINT' UNION ALL SELECT 'gaps', 'DOUBLE' UNION ALL SELECT 'ordered', 'TIMESTAMP'""")
def _(t):
    return S.infer_types(as_text(t))


@query("coerce_values", f"""
SELECT o_orderkey, CAST(TRY_CAST(cust AS DOUBLE) AS BIGINT) AS cust, CAST(trunc(TRY_CAST(price AS DOUBLE)) AS BIGINT) AS price,
 TRY_CAST(mostly AS DOUBLE) AS mostly, CAST(trunc(TRY_CAST(mixed AS DOUBLE)) AS BIGINT) AS mixed, status FROM {UNTYPED}""")
def _(t):
    types = {"cust": "BIGINT", "price": "BIGINT", "mostly": "DOUBLE", "mixed": "BIGINT", "status": "STRING"}
    return S.coerce_values(as_text(t).drop("gaps", "ordered"), types)


@query("coerce_form_values", f"""
WITH f AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN cust WHEN 1 THEN price WHEN 2 THEN status WHEN 3 THEN '1.2.3' ELSE '' END AS v FROM {UNTYPED})
SELECT o_orderkey, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN 'int' WHEN regexp_matches(v, '^([0-9]+\\.[0-9]*|\\.[0-9]+)$') THEN 'float' ELSE 'text' END AS kind,
 CASE WHEN regexp_matches(v, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST(v AS DOUBLE) END AS number,
 CASE WHEN NOT regexp_matches(v, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN v END AS text FROM f""")
def _(t):
    k = F.col("o_orderkey") % 5
    value = (
        F.when(k == 0, F.col("cust")).when(k == 1, F.col("price")).when(k == 2, F.col("status"))
        .when(k == 3, "1.2.3").otherwise(F.lit(None).cast("string"))
    )
    return as_text(t).select("o_orderkey", S.coerce_form(value).alias("v")).select("o_orderkey", "v.*")


@query("billing_defaults", """
SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS enterprise_id, CAST(l_partkey AS VARCHAR) AS subaccount, l_returnflag AS device_type,
 '' AS service_type, CASE WHEN l_linenumber = 3 THEN 0.0 ELSE l_extendedprice END AS monthly_rate,
 CASE WHEN l_linenumber = 4 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS bandwidth_mbps, '2024-01-01' AS contract_start,
 '2024-12-31' AS contract_end, CASE WHEN l_linestatus = 'F' THEN 'ACTIVE' ELSE 'a status longer than' END AS status FROM lineitem""")
def _(t):
    line = F.col("l_linenumber")
    upload = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("enterprise"), F.col("l_partkey").alias("sub_account"),
        F.col("l_returnflag").alias("device_type"),
        F.when(line == 3, "unknown").otherwise(F.col("l_extendedprice").cast("string")).alias("rate"),
        F.when(line == 4, "fast").otherwise(F.col("l_quantity").cast("string")).alias("bandwidth"),
        F.when(F.col("l_linestatus") == "F", None).otherwise("a status longer than twenty characters").alias("status"),
    )
    return S.billing_defaults(upload)


@query("lineage_columns", """
SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS id, 'orders.parquet' AS source_file, strftime(o_orderdate, '%Y-%m') AS data_month FROM orders""")
def _(t):
    out = S.lineage_columns(
        t.orders.select("o_orderkey", "o_orderdate", F.col("_metadata.file_name").alias("file")),
        F.col("file"), F.col("o_orderdate"), F.md5(F.col("o_orderkey").cast("string")),
    )
    return out.select("o_orderkey", "id", "source_file", "data_month")


def _profiled(c, numeric=True):
    parts = [("missing", f"CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE)"), ("missing_pct", rd(f"100.0 * count(*) FILTER ({c} IS NULL) / count(*)", 2))]
    if numeric:
        parts += [("count", f"CAST(count({c}) AS DOUBLE)"), ("mean", rd(f"avg({c})", 4)), ("std", rd(f"stddev_samp({c})", 4)),
                  ("min", f"CAST(min({c}) AS DOUBLE)"), ("max", f"CAST(max({c}) AS DOUBLE)")]
    return [f"""SELECT '{c}' AS "column", '{m}' AS metric, {e} AS value FROM h""" for m, e in parts]


HOLES = "WITH h AS (SELECT l_quantity, nullif(l_tax, 0.05) AS tax, nullif(l_returnflag, 'A') AS flag FROM lineitem) "


@query("profile", HOLES + " UNION ALL ".join(
    _profiled("l_quantity") + _profiled("tax") + _profiled("flag", False)
    + [f"""SELECT '{c}', '{int(p * 100)}%', {rd(f'quantile_cont({c}, {p})', 4)} FROM h""" for c in ("l_quantity", "tax") for p in (0.25, 0.5, 0.75)]))
def _(t):
    holes = t.lineitem.select(
        "l_quantity", F.nullif("l_tax", F.lit(0.05)).alias("tax"), F.nullif("l_returnflag", F.lit("A")).alias("flag")
    )
    points = S.quartiles(holes, ["l_quantity", "tax"])
    return S.profile(holes).unionByName(points.withColumn("value", S.round_to(F.col("value"), 4)))


def typed_text(t):
    return as_text(t).select(
        "o_orderkey", F.col("price").alias("total_price"), F.col("cust").alias("cust_code"), "status", "mixed",
        F.date_format("ordered", "yyyy-MM-dd").alias("placed"), F.nullif("status", F.lit("P")).alias("half"),
    )


KINDS = f"""
WITH u AS (SELECT *, strftime(o.o_orderdate, '%Y-%m-%d') AS placed FROM {UNTYPED} x JOIN orders o USING (o_orderkey))
SELECT 'total_price' AS "column", 0 AS position, 'numeric' AS kind, 0 AS nulls, count(DISTINCT price) AS distinct_values FROM u
UNION ALL SELECT 'cust_code', 1, 'identifier', 0, count(DISTINCT cust) FROM u
UNION ALL SELECT 'status', 2, 'categorical', 0, count(DISTINCT status) FROM u
UNION ALL SELECT 'mixed', 3, 'text', 0, count(DISTINCT mixed) FROM u
UNION ALL SELECT 'placed', 4, 'timestamp', 0, count(DISTINCT placed) FROM u
UNION ALL SELECT 'half', 5, 'categorical', count(*) FILTER (status = 'P'), count(DISTINCT nullif(status, 'P')) FROM u"""


@query("semantic_types", KINDS)
def _(t):
    return S.semantic_types(typed_text(t), "o_orderkey")


@query("suggest_roles", f"WITH k AS ({KINDS}) SELECT (SELECT \"column\" FROM k WHERE kind='numeric') AS target, (SELECT \"column\" FROM k WHERE kind='timestamp') AS time_index")
def _(t):
    return S.suggest_roles(S.semantic_types(typed_text(t), "o_orderkey"))


@query("impute", """
WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_totalprice END AS price, nullif(o_orderpriority, '3-MEDIUM') AS priority FROM orders)
SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM h)), 6) AS price,
  coalesce(priority, (SELECT priority FROM h WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM h""")
def _(t):
    k = F.col("o_orderkey")
    holes = t.orders.select(
        k, F.when(k % 5 == 2, None).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("priority"),
    )
    return S.impute(holes, ["price"], (), ["priority"]).withColumn("price", F.round("price", 6))


@query("schema_score", f"""
WITH u AS ({UNTYPED[1:-1]}),
p AS (SELECT CASE WHEN count(TRY_CAST(price AS DOUBLE)) = count(price) THEN 0.0 ELSE 1.0 END AS point FROM u
 UNION ALL SELECT CASE WHEN count(DISTINCT status) < 50 AND count(DISTINCT status) < 0.5 * count(*) THEN 1.0 ELSE 0.5 END FROM u
 UNION ALL SELECT CASE WHEN count(o_orderdate) = count(*) THEN 1.0 ELSE 0.0 END FROM orders UNION ALL SELECT 0.5 FROM (SELECT count(*) FROM u))
SELECT count(*) AS columns_checked, {rd('avg(point) * 100', 2)} AS accuracy, avg(point) * 100 > 90 AS meets_target FROM p""")
def _(t):
    df = as_text(t).select("o_orderkey", "price", "status", F.col("ordered").alias("placed"), F.col("gaps").alias("gap_code"))
    # price is numeric text (0), status categorical (1), placed a time (1), gap_code an identifier (0.5), so (0+1+1+0.5)/4
    kinds = S.semantic_types(df, "o_orderkey")
    return S.schema_score(kinds, df)


@query("row_to_text", """
SELECT o_orderkey, 'O Orderkey: ' || o_orderkey || coalesce('. Price: ' || format('{:,.2f}', CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_totalprice END), '')
  || '. O Orderstatus: ' || o_orderstatus || '. O Orderdate: ' || strftime(o_orderdate, '%B %d, %Y') AS text FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    df = t.orders.select(
        k, F.when(k % 5 == 2, None).otherwise(F.col("o_totalprice")).alias("price"), "o_orderstatus", "o_orderdate",
        F.col("o_totalprice").alias("lag_1"),
    )
    return df.select("o_orderkey", S.row_to_text(df).alias("text"))
