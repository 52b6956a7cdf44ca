"""Question tagging over questions that Spark builds from the part table and over the conversations."""

from pyspark.sql import functions as F

from brindle.functions.text import WHITESPACE
from brindle.operators import questions as Q
from brindle.plans.spec import QuerySpec, format_answer, result_json, run_spec
from brindle.queries import query, rd

# question forms; each part asks one of them about its own type
FORMS = (
    "How many customers churned on", "What is the average monthly charge per contract for", "List all customers with",
    "Top 5 customers by total charges and", "What is the churn rate by gender of", "Explain how attention works in",
    "Compare monthly charges with churn pattern of", "What are the lowest 20 tenure months of", "Show customers not churned in",
    "Total revenue of senior females and males on fiber", "Predict churn and show me a chart breakdown for",
    "According to the document, what is", "maximum cost by internet for dsl customers who stayed in",
    "Count of month-to-month contracts by payment for", "Describe the theory of", "What is 42 to", "Is there a", "Which country has",
    "why is the revenue model of", "Visualize feature importance of the classification of",
)


def questions(t):
    forms = F.array(*[F.lit(f) for f in FORMS])
    form = F.element_at(forms, (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    asked = t.wide("part", "p_partkey").select(F.lit("part").alias("source"), F.col("p_partkey").alias("k"), F.concat_ws(" ", form, "p_type").alias("text"))
    said = t.wide("conversations", "conv_id").select(
        F.lit("talk").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text"
    )
    return asked.unionByName(said)


def quoted(s):
    return "'" + s.replace("'", "''") + "'"


ASKED = f"""(SELECT 'part' AS source, p_partkey AS k, CASE p_partkey % {len(FORMS)} {' '.join(f"WHEN {i} THEN {quoted(f)}" for i, f in enumerate(FORMS))} END || ' ' || p_type AS text FROM part
 UNION ALL SELECT 'talk', conv_id * 1000 + turn, text FROM conversations)"""
LOW = f"(SELECT source, k, regexp_replace(lower(text), '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g') AS q FROM {ASKED})"


def any_of(words):
    return "(" + " OR ".join(f"contains(q, {quoted(w)})" for w in words) + ")"


def found(words):
    return f"list_filter([{', '.join(quoted(w) for w in words)}], lambda w: contains(q, w))"


ROUTED = f"""
WITH m AS (SELECT *, {found(Q.DATA_WORDS)} AS dm, {found(Q.KNOWLEDGE_WORDS)} AS km, {found(Q.HYBRID_WORDS)} AS hm FROM {LOW}),
s AS (SELECT *, len(dm) AS d, len(km) AS kn, 2 * len(hm) AS h, len(dm) + len(km) + 2 * len(hm) AS total FROM m),
r AS (SELECT *, CASE WHEN total = 0 AND (regexp_matches(q, '^how many') OR regexp_matches(q, '\\d+')) THEN 'numeric' WHEN total = 0 AND regexp_matches(q, '^what (is|are)') THEN 'what'
 WHEN total = 0 THEN 'none' WHEN h > 0 AND h >= greatest(d, kn) THEN 'hybrid' WHEN d > kn THEN 'data' WHEN kn > d THEN 'knowledge'
 WHEN regexp_matches(q, '\\d+|customer|churn|revenue') THEN 'tie_data' ELSE 'tie_knowledge' END AS rule FROM s)"""
INTENT = f"""CASE rule WHEN 'numeric' THEN 'Data query (heuristic)' WHEN 'what' THEN 'Knowledge query (heuristic)' WHEN 'none' THEN 'Could not determine query type'
 WHEN 'hybrid' THEN 'Hybrid query (needs both data and document context)' WHEN 'tie_data' THEN 'Data query (tie-breaker)' WHEN 'tie_knowledge' THEN 'Knowledge query (tie-breaker)'
 WHEN 'data' THEN CASE WHEN contains(q, 'how many') OR list_contains(dm, 'count') THEN 'Count/aggregate data query' WHEN contains(q, 'average') OR list_contains(dm, 'avg') THEN 'Average calculation query'
  WHEN {any_of(('top', 'highest'))} THEN 'Top/ranking query' WHEN {any_of(('list', 'show'))} THEN 'List/display query' WHEN contains(q, 'churn') THEN 'Churn analysis query' ELSE 'General data query' END
 ELSE CASE WHEN contains(q, 'what is') OR list_contains(km, 'definition') THEN 'Definition/explanation query' WHEN contains(q, 'how does') OR list_contains(km, 'explain') THEN 'Process/mechanism query'
  WHEN contains(q, 'why') THEN 'Reasoning/causation query' ELSE 'General knowledge query' END END"""


@query("route_questions", f"""{ROUTED}
SELECT source, k, CASE WHEN rule = 'hybrid' THEN 'hybrid' WHEN rule IN ('numeric', 'data', 'tie_data') THEN 'data' WHEN rule = 'none' THEN 'unknown' ELSE 'knowledge' END AS query_type,
 {rd("CASE rule WHEN 'none' THEN 0.0 WHEN 'hybrid' THEN CAST(h AS DOUBLE) / total WHEN 'data' THEN CAST(d AS DOUBLE) / total WHEN 'knowledge' THEN CAST(kn AS DOUBLE) / total ELSE 0.5 END", 6)} AS confidence,
 array_to_string(CASE rule WHEN 'numeric' THEN ['heuristic: numeric question'] WHEN 'what' THEN ['heuristic: what is question'] WHEN 'none' THEN [] WHEN 'hybrid' THEN hm[1:5]
  WHEN 'data' THEN dm[1:5] WHEN 'tie_data' THEN dm[1:5] ELSE km[1:5] END, '|') AS matched FROM r""")
def _(t):
    out = Q.route_questions(questions(t), "text")
    return out.select(
        "source", "k", "query_type", F.round(F.col("confidence").cast("decimal(38,8)"), 6).cast("double").alias("confidence"),
        F.array_join("matched", "|").alias("matched"),
    )


@query("route_intent", f"{ROUTED} SELECT source, k, {INTENT} AS intent FROM r")
def _(t):
    return Q.route_questions(questions(t), "text").select("source", "k", "intent")


def first_of(table):
    pairs = table.items() if isinstance(table, dict) else [(w, (w,)) for w in table]
    return "CASE " + " ".join(f"WHEN {any_of(words)} THEN {quoted(key)}" for key, words in pairs) + " END"


AGG = "CASE " + " ".join(
    f"WHEN regexp_matches(q, '\\b({'|'.join(words)})s?\\b') THEN '{name}'" for name, words in Q.AGGREGATE_WORDS.items()) + " END"
SPEC = f"""
WITH a AS (SELECT *, {any_of(Q.LIST_WORDS)} AS listing, {any_of(Q.TOP_WORDS)} AS is_top, {any_of(Q.BOTTOM_WORDS)} AS is_bottom, contains(q, 'female') AS female,
  regexp_matches(q, '\\bmales?\\b') AS male, TRY_CAST(nullif(regexp_extract(q, '\\b(\\d+)\\b', 1), '') AS INTEGER) AS n FROM {LOW}),
b AS (SELECT *, CASE WHEN NOT listing THEN {AGG} END AS agg FROM a)
SELECT source, k, agg, CASE WHEN agg <> 'COUNT' THEN {first_of(Q.AGGREGATE_TERMS)} END AS agg_term,
 CASE WHEN {any_of(Q.NEGATIVE_WORDS)} THEN 'negative' WHEN {any_of(Q.POSITIVE_WORDS)} THEN 'positive' END AS outcome,
 {first_of(Q.VALUE_WORDS['contract'])} AS contract, CASE WHEN female AND NOT male THEN 'Female' WHEN NOT female AND contains(q, 'male') THEN 'Male' END AS gender,
 contains(q, 'senior') AS senior, {first_of(Q.VALUE_WORDS['internet'])} AS internet,
 CASE WHEN agg IS NOT NULL THEN coalesce({first_of(Q.GROUP_WORDS)}, CASE WHEN female AND male THEN 'gender' END) END AS group_by,
 CASE WHEN agg IS NULL AND {any_of(Q.SORT_WORDS)} THEN coalesce({first_of(Q.ORDER_TERMS)}, 'total') END AS order_term,
 is_top OR NOT is_bottom AS descending,
 CAST(CASE WHEN (is_top OR is_bottom) AND n IS NOT NULL THEN n WHEN listing AND NOT contains(q, 'all') THEN 50 WHEN is_top OR is_bottom THEN 10 END AS INTEGER) AS row_limit FROM b"""


@query("tag_query_spec", SPEC)
def _(t):
    return Q.tag_query_spec(questions(t), "text").drop("text")


STEPS = {
    "rag_answer": "needs_documents", "sql_query": "needs_data", "ml_train": "needs_ml",
    "ml_batch_predict": "needs_ml AND contains(q, 'predict')",
    "ml_feature_importance": "needs_ml AND (contains(q, 'feature') OR contains(q, 'importance'))",
    "chart_distribution": "needs_chart AND (contains(q, 'distribution') OR contains(q, 'churn'))",
    "chart_by_category": "needs_chart AND (contains(q, 'category') OR contains(q, 'breakdown'))",
}


@query("tag_needs", f"""
WITH f AS (SELECT *, {', '.join(f'{any_of(words)} AS {name}' for name, words in Q.NEED_WORDS.items())} FROM {LOW}),
s AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {on} THEN '{step}' END" for step, on in STEPS.items())}], lambda x: x IS NOT NULL) AS st FROM f)
SELECT source, k, needs_data, needs_ml, needs_chart, needs_documents, CASE WHEN len(st) = 0 THEN 'data_stats' ELSE array_to_string(st, '|') END AS steps FROM s""")
def _(t):
    return Q.tag_needs(questions(t), "text").withColumn("steps", F.array_join("steps", "|")).drop("text")


ALIASES = {"contract": ("orderpriority",), "total": ("totalprice",), "monthly": ("totalprice",), "churn": ("churn_label",), "customer": ("custkey",)}


def order_account(t):
    return t.orders.withColumn("churn_label", F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No"))


ASKED_OF_ORDERS = (
    "How many customers churned by contract", "What is the average total charges of customers not churned",
    "total revenue by contract", "maximum charge", "How many customers",
)


@query("run_query_spec", f"""
SELECT 0 AS question, o_orderpriority AS "group", CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 2
UNION ALL SELECT 1, NULL, {rd('avg(o_totalprice)', 2)} FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 2, o_orderpriority, {rd('sum(o_totalprice)', 2)} FROM orders GROUP BY 2
UNION ALL SELECT 3, NULL, {rd('max(o_totalprice)', 2)} FROM orders UNION ALL SELECT 4, NULL, CAST(count(*) AS DOUBLE) FROM orders""")
def _(t):
    account = order_account(t)
    asked = t.spark.createDataFrame([(i, q) for i, q in enumerate(ASKED_OF_ORDERS)], "question int, text string")
    out = None
    for tags in Q.tag_query_spec(asked, "text").collect():
        spec = Q.spec_of(tags, account, "churn_label", ALIASES)
        result = run_spec(account, spec)
        part = result.select(
            F.lit(tags["question"]).alias("question"),
            (F.col(spec.group_by[0]) if spec.group_by else F.lit(None).cast("string")).alias("group"),
            F.col(result.columns[-1]).cast("double").alias("value"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("answer_format", f"""
SELECT 'count' AS kind, 'There are **' || format('{{:,}}', count(*)) || '** customers in the database.' AS answer FROM orders
UNION ALL SELECT 'average', 'The avg o totalprice is **' || format('{{:,.2f}}', {rd('avg(o_totalprice)', 2)}) || '**' FROM orders
UNION ALL SELECT 'groups', 'Here''s the breakdown:' || chr(10) || string_agg('• ' || p || ': ' || format('{{:,}}', n), chr(10) ORDER BY n DESC, p) FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
UNION ALL SELECT 'list', 'Found **' || count(*) || '** records. Showing the data in the table below.' FROM orders WHERE o_totalprice > 400000""")
def _(t):
    account = order_account(t)
    specs = {
        "count": QuerySpec(agg="COUNT"), "average": QuerySpec(agg="AVG", column="o_totalprice"),
        "groups": QuerySpec(agg="COUNT", group_by=("o_orderpriority",)),
        "list": QuerySpec(columns=("o_orderkey",), filters=(F.col("o_totalprice") > 400000,), limit=None),
    }
    out = None
    for kind, spec in specs.items():
        answer = format_answer(run_spec(account, spec), spec, " customers").select(F.lit(kind).alias("kind"), "answer")
        out = answer if out is None else out.unionByName(answer)
    return out


@query("result_json", """
SELECT '{"o_orderpriority":"' || o_orderpriority || '","count":' || count(*) || ',"first":"' || strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') || '"}' AS "row" FROM orders GROUP BY o_orderpriority""")
def _(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("count"), F.min("o_orderdate").alias("first"))
    return result_json(counts)
