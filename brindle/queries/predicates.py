"""Filters, outcome flags, term resolution and input screens."""

from pyspark.sql import functions as F

from brindle.functions import predicates as P
from brindle.functions.text import WHITESPACE
from brindle.operators.schema import select_features
from brindle.operators.stats import summary_stats
from brindle.plans.spec import QuerySpec, resolve_term, run_spec
from brindle.queries import query, rd
from brindle.queries.statistics import account

# words of a question, and the spellings of the columns that stand for them here
ALIASES = {
    "customer": ("custkey",), "contract": ("orderpriority",), "total": ("totalprice",),
    "churn": ("orderstatus",), "tenure": ("orderdate",),
}


@query("project_listing", """
SELECT o_custkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50""")
def _(t):
    words = ("customer", "contract", "total", "churn")
    columns = tuple(resolve_term(t.orders.columns, w, ALIASES) for w in words)
    return run_spec(t.orders, QuerySpec(columns=columns, order_by="o_orderkey", desc=False, limit=50))


@query("filter_equal", """
SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey=c_custkey
WHERE o_orderpriority='1-URGENT' AND c_mktsegment='BUILDING' AND o_orderstatus='F'""")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    wanted = {"o_orderpriority": "1-URGENT", "c_mktsegment": "BUILDING", "o_orderstatus": "F"}
    spec = QuerySpec(
        columns=("o_orderkey", "o_totalprice"), filters=tuple(F.col(c) == v for c, v in wanted.items()), limit=None
    )
    return run_spec(joined, spec)


@query("filter_target", "SELECT l_returnflag='R' AS positive, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    a = account(t)
    hit = P.target_flag(a, "churn_label")
    yes = run_spec(a, QuerySpec(agg="COUNT", filters=(hit,))).select(F.lit(True).alias("positive"), F.col("count").alias("n"))
    no = run_spec(a, QuerySpec(agg="COUNT", filters=(~hit,))).select(F.lit(False).alias("positive"), F.col("count").alias("n"))
    return yes.unionByName(no)


@query("target_flag", """
SELECT upper(CASE WHEN o_orderkey % 7 = 0 THEN 'yes' WHEN o_orderkey % 7 = 1 THEN 'True' WHEN o_orderkey % 7 = 2 THEN 'churned' ELSE o_orderstatus END)
  IN ('YES','TRUE','1','Y','CHURNED') AS flag, toxic = 1 AS numeric_flag, count(*) AS n
FROM orders JOIN labels ON o_orderkey = doc_id GROUP BY 1, 2""")
def _(t):
    rows = t.orders.join(t.labels, F.col("o_orderkey") == F.col("doc_id"))
    k = F.col("o_orderkey") % 7
    spelled = F.when(k == 0, "yes").when(k == 1, "True").when(k == 2, "churned").otherwise(F.col("o_orderstatus"))
    rows = rows.withColumn("spelled", spelled)
    return rows.groupBy(
        P.target_flag(rows, "spelled").alias("flag"), P.target_flag(rows, "toxic").alias("numeric_flag")
    ).agg(F.count("*").alias("n"))


@query("target_binary", """
SELECT y, count(*) AS n FROM (SELECT CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END AS y FROM lineitem) GROUP BY 1""")
def _(t):
    from brindle.operators.models import binary_target

    spelled = t.lineitem.select(F.when(F.col("l_linestatus") == "F", "Departed").otherwise("stayed").alias("outcome"))
    return binary_target(spelled, "outcome", "y").groupBy("y").agg(F.count("*").alias("n"))


@query("resolve_target", """
SELECT 'churn_label' AS target, count(*) AS total,
  CAST(count(*) FILTER (l_returnflag='R') AS BIGINT) AS positive FROM lineitem""")
def _(t):
    a = account(t)
    target = P.resolve_target(a.columns)
    return summary_stats(a, target, []).select(F.lit(target).alias("target"), "total", "positive")


@query("select_features", """
SELECT feature, kind, distinct_values FROM (
  SELECT 'l_quantity' AS feature, 'numeric' AS kind, count(DISTINCT l_quantity) AS distinct_values FROM lineitem
  UNION ALL SELECT 'l_linenumber', 'numeric', count(DISTINCT l_linenumber) FROM lineitem
  UNION ALL SELECT 'l_orderkey', 'numeric', count(DISTINCT l_orderkey) FROM lineitem
  UNION ALL SELECT 'l_partkey', 'numeric', count(DISTINCT l_partkey) FROM lineitem
  UNION ALL SELECT 'l_suppkey', 'numeric', count(DISTINCT l_suppkey) FROM lineitem
  UNION ALL SELECT 'l_discount', 'numeric', count(DISTINCT l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'numeric', count(DISTINCT l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_tax', 'numeric', count(DISTINCT l_tax) FROM lineitem
  UNION ALL SELECT 'l_linestatus', 'categorical', count(DISTINCT l_linestatus) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'categorical', count(DISTINCT l_returnflag) FROM lineitem)""")
def _(t):
    a = account(t)
    categorical, numeric = select_features(a, "churn_label")
    tall = a.select(*[F.col(c).cast("string").alias(c) for c in categorical + numeric]).unpivot(
        [], categorical + numeric, "feature", "value"
    )
    kind = F.when(F.col("feature").isin(*categorical), "categorical").otherwise("numeric")
    # (feature, value) pairs are deduplicated first, so no feature is counted by a single task
    return tall.distinct().groupBy("feature").agg(F.count("value").alias("distinct_values")).select(
        "feature", kind.alias("kind"), "distinct_values"
    )


@query("resolve_term", f"SELECT {rd('avg(o_totalprice)', 2)} AS avg_o_totalprice FROM orders")
def _(t):
    return run_spec(t.orders, QuerySpec(agg="AVG", column=resolve_term(t.orders.columns, "total charges", ALIASES)))


@query("safe_select", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000
ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""")
def _(t):
    df = t.orders
    conditions = [
        P.safe_predicate(df, "o_orderstatus", "=", "O"), P.safe_predicate(df, "o_totalprice", ">=", 1000),
        P.safe_predicate(df, "password", "=", "x"),
    ]
    return P.safe_select(df, ["o_orderkey", "o_totalprice", "password"], conditions, "o_totalprice", 200, ("o_orderkey",))


CONDITIONS = [
    ("=", "o_orderstatus", "F", "o_orderstatus = 'F'"),
    ("!=", "o_orderstatus", "F", "o_orderstatus <> 'F'"),
    ("<", "o_totalprice", 50000, "o_totalprice < 50000"),
    (">", "o_totalprice", 50000, "o_totalprice > 50000"),
    ("<=", "o_custkey", 100, "o_custkey <= 100"),
    (">=", "o_custkey", 100, "o_custkey >= 100"),
    ("LIKE", "o_orderpriority", "%URG%", "o_orderpriority LIKE '%URG%'"),
    ("IN", "o_orderstatus", ["O", "P"], "o_orderstatus IN ('O', 'P')"),
    ("IS NULL", "o_orderstatus", None, "o_orderstatus IS NULL"),
    ("IS NOT NULL", "o_orderstatus", None, "o_orderstatus IS NOT NULL"),
]


@query("safe_predicate", " UNION ALL ".join(
    f"SELECT '{op}' AS op, count(*) FILTER ({sql}) AS n FROM orders" for op, _, _, sql in CONDITIONS))
def _(t):
    df = t.orders
    wide = df.agg(*[
        F.count_if(P.safe_predicate(df, column, op, value)).alias(op) for op, column, value, _ in CONDITIONS
    ])
    return wide.unpivot([], wide.columns, "op", "n")


def _re2(pattern):
    return pattern.replace("'", "''")


WS = WHITESPACE.replace("{", "{{").replace("}", "}}")
STRIPPED = f"regexp_replace({{0}}, '^{WS}+|{WS}+$', '', 'g')"
VERDICT = f"""CASE WHEN {{0}} IS NULL OR {{0}} = '' THEN 'empty' WHEN length({STRIPPED}) > {P.MAX_QUESTION_CHARS} THEN 'too_long'
WHEN {' OR '.join(f"regexp_matches({STRIPPED}, '(?i){_re2(p)}')" for p in P.INJECTION_PATTERNS)} THEN 'dangerous' ELSE 'ok' END"""
FIRST = "CASE " + " ".join(
    f"WHEN regexp_matches({STRIPPED}, '(?i){_re2(p)}') THEN {i}" for i, p in enumerate(P.INJECTION_PATTERNS, 1)) + " ELSE 0 END"

# part names with one of the attack texts appended, chosen by size
ATTACKS = (
    "", "; -- x", "; drop table t", "; delete from t", "; update t", "; insert into t", "; alter table", "; create x",
    "; truncate t", "union  select 1", "or 1 = 1", "or 'a' = 'a'", "tail --", "/* c */", "plain words",
)


def _attacked(t):
    texts = F.array(*[F.lit(a) for a in ATTACKS])
    return t.part.select(
        "p_partkey",
        F.concat_ws(" ", "p_name", F.element_at(texts, (F.col("p_size") % len(ATTACKS) + 1).cast("int"))).alias("text"),
    )


ATTACKED = "(SELECT p_partkey AS k, p_name || ' ' || CASE p_size % {} {} END AS text FROM part)".format(
    len(ATTACKS), " ".join(f"WHEN {i} THEN '{_re2(a)}'" for i, a in enumerate(ATTACKS)))


@query("injection_screen", f"""
SELECT 'page' AS source, page_id AS k, {VERDICT.format('html')} AS verdict, {FIRST.format('html')} AS pattern FROM pages
UNION ALL SELECT 'part', k, {VERDICT.format('text')}, {FIRST.format('text')} FROM {ATTACKED}
UNION ALL SELECT 'document', doc_id, {VERDICT.format('text')}, {FIRST.format('text')} FROM documents""")
def _(t):
    texts = (
        t.wide("pages", "page_id").select(F.lit("page").alias("source"), F.col("page_id").alias("k"), F.col("html").alias("text"))
        .unionByName(_attacked(t).select(F.lit("part").alias("source"), F.col("p_partkey").alias("k"), "text"))
        .unionByName(t.wide("documents", "doc_id").select(F.lit("document").alias("source"), F.col("doc_id").alias("k"), "text"))
    )
    return texts.select(
        "source", "k", P.injection_verdict(F.col("text")).alias("verdict"), P.injection_pattern(F.col("text")).alias("pattern")
    )


@query("field_length_screen", f"""
SELECT doc_id, length(text) <= {P.MAX_FIELD_CHARS} AS valid,
  CASE WHEN length(text) <= {P.MAX_FIELD_CHARS} THEN md5({STRIPPED.format('text')}) END AS value_md5 FROM documents""")
def _(t):
    screened = t.documents.select("doc_id", P.field_screen(F.col("text")).alias("s"))
    return screened.select("doc_id", "s.valid", F.md5("s.value").alias("value_md5"))
