"""Tags for tables of questions: route, intent, query parts and needed steps, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from brindle.functions.predicates import target_flag
from brindle.functions.text import contains_any, matches, strip
from brindle.plans.spec import (
    COLUMN_ALIASES, LIST_LIMIT, TOP_LIMIT, QuerySpec, resolve_term,
)

# Words that mark a question as one for the data, for the documents, or for both.
DATA_WORDS = (
    "how many", "count", "number of", "total number", "total count",
    "average", "avg", "mean",
    "sum", "sum of", "total revenue", "total cost",
    "maximum", "max", "highest", "largest", "top",
    "minimum", "min", "lowest", "smallest", "bottom",
    "customers", "customer", "records", "rows",
    "churned", "churn rate", "retention",
    "revenue", "charges", "monthly charge",
    "tenure", "months",
    "list all", "show all", "display", "get all",
    "breakdown", "by contract", "by gender", "per",
    "filter", "where", "who has",
    "statistics", "stats", "metrics", "kpi",
)
KNOWLEDGE_WORDS = (
    "what is", "what are", "what's",
    "explain", "explain how", "explain why",
    "how does", "how do", "how can",
    "why is", "why does", "why do",
    "describe", "definition", "define",
    "tell me about", "what do you know about",
    "meaning of", "concept of",
    "according to", "based on the document", "in the paper",
    "the document says", "the article", "the text",
    "mechanism", "process", "method", "approach",
    "algorithm", "technique", "strategy",
    "theory", "principle", "concept",
    "architecture", "model", "framework",
    "attention", "transformer", "neural", "learning",
)
HYBRID_WORDS = (
    "based on our data", "according to both",
    "compare", "correlation", "relationship between",
    "why are customers churning", "explain our churn",
    "analyze", "insight", "pattern",
)
HYBRID_WEIGHT, SHOWN_MATCHES = 2, 5

# Aggregate words in the order they are tried.
AGGREGATE_WORDS = {
    "COUNT": ("how many", "count", "number of", "total number"),
    "AVG": ("average", "avg", "mean"),
    "SUM": ("total", "sum", "sum of"),
    "MAX": ("maximum", "max", "highest", "largest"),
    "MIN": ("minimum", "min", "lowest", "smallest"),
}
AGGREGATE_TERMS = ("charge", "revenue", "cost", "monthly", "total", "tenure", "months")
ORDER_TERMS = ("charge", "revenue", "cost", "monthly", "total", "tenure")
POSITIVE_WORDS = ("churned", "who churned", "churn = 1", "left", "departed")
NEGATIVE_WORDS = ("not churned", "stayed", "retained", "active")
VALUE_WORDS = {
    "contract": {
        "Month-to-month": ("month-to-month", "monthly contract"),
        "One year": ("one year", "yearly"),
        "Two year": ("two year",),
    },
    "internet": {"Fiber optic": ("fiber",), "DSL": ("dsl",)},
}
GROUP_WORDS = {
    "contract": ("by contract", "per contract", "for each contract"),
    "gender": ("by gender", "per gender", "for each gender"),
    "internet": ("by internet", "per internet"),
    "payment": ("by payment", "per payment"),
}
TOP_WORDS, BOTTOM_WORDS = ("top", "highest", "most"), ("bottom", "lowest", "least")
SORT_WORDS = ("top", "bottom", "highest", "lowest")
LIST_WORDS = ("list", "show", "display", "get all")

# Words that call for data, a model, a chart or documents, and the step names.
NEED_WORDS = {
    "needs_data": (
        "how many", "count", "average", "total", "show", "list", "customers", "records", "data", "statistics", "stats",
    ),
    "needs_ml": (
        "predict", "train", "model", "churn", "risk", "forecast", "feature importance", "classification",
    ),
    "needs_chart": ("chart", "graph", "plot", "visualize", "visualization", "show me"),
    "needs_documents": (
        "document", "explain", "what is", "how does", "describe", "according to", "paper", "article",
    ),
}


def _first_of(low: Column, phrases: dict | tuple) -> Column:
    """Key of the first entry one of whose phrases occurs; a plain tuple is its own key."""
    table = phrases if isinstance(phrases, dict) else {p: (p,) for p in phrases}
    out = F.lit(None).cast("string")
    for key, words in reversed(table.items()):
        out = F.when(contains_any(low, words), key).otherwise(out)
    return out


def route_questions(df: DataFrame, text: str) -> DataFrame:
    """Adds query_type, confidence, matched (up to five words) and intent."""
    low = strip(F.lower(text))
    scored = df.withColumns({
        "_low": low, "_data": matches(low, DATA_WORDS), "_know": matches(low, KNOWLEDGE_WORDS),
        "_hyb": matches(low, HYBRID_WORDS),
    }).withColumns({
        "_d": F.size("_data"), "_k": F.size("_know"), "_h": F.size("_hyb") * HYBRID_WEIGHT,
    }).withColumn("_all", F.col("_d") + F.col("_k") + F.col("_h"))
    q, d, k, h, total = (F.col(c) for c in ("_low", "_d", "_k", "_h", "_all"))
    numeric = q.rlike(r"^how many") | q.rlike(r"\d+")
    tied_data = q.rlike(r"\d+|customer|churn|revenue")
    rule = (
        F.when((total == 0) & numeric, "numeric")
        .when((total == 0) & q.rlike("^what (is|are)"), "what")
        .when(total == 0, "none")
        .when((h > 0) & (h >= F.greatest(d, k)), "hybrid")
        .when(d > k, "data").when(k > d, "knowledge")
        .when(tied_data, "tie_data").otherwise("tie_knowledge")
    )
    ruled = scored.withColumn("_rule", rule)
    r = F.col("_rule")

    def has(column: str, word: str) -> Column:
        return F.array_contains(column, word)

    data_intent = (
        F.when(F.contains(q, F.lit("how many")) | has("_data", "count"), "Count/aggregate data query")
        .when(F.contains(q, F.lit("average")) | has("_data", "avg"), "Average calculation query")
        .when(contains_any(q, ("top", "highest")), "Top/ranking query")
        .when(contains_any(q, ("list", "show")), "List/display query")
        .when(F.contains(q, F.lit("churn")), "Churn analysis query")
        .otherwise("General data query")
    )
    knowledge_intent = (
        F.when(F.contains(q, F.lit("what is")) | has("_know", "definition"), "Definition/explanation query")
        .when(F.contains(q, F.lit("how does")) | has("_know", "explain"), "Process/mechanism query")
        .when(F.contains(q, F.lit("why")), "Reasoning/causation query")
        .otherwise("General knowledge query")
    )
    share = F.when(r == "hybrid", h).when(r == "data", d).when(r == "knowledge", k) / total
    return ruled.withColumns({
        "query_type": F.when(r == "hybrid", "hybrid").when(r.isin("numeric", "data", "tie_data"), "data")
        .when(r == "none", "unknown").otherwise("knowledge"),
        "confidence": F.when(r == "none", 0.0).when(r.isin("hybrid", "data", "knowledge"), F.least(share, F.lit(1.0))).otherwise(0.5),
        "matched": F.when(r == "numeric", F.array(F.lit("heuristic: numeric question")))
        .when(r == "what", F.array(F.lit("heuristic: what is question")))
        .when(r == "none", F.array().cast("array<string>"))
        .when(r == "hybrid", F.slice("_hyb", 1, SHOWN_MATCHES))
        .when(r.isin("data", "tie_data"), F.slice("_data", 1, SHOWN_MATCHES))
        .otherwise(F.slice("_know", 1, SHOWN_MATCHES)),
        "intent": F.when(r == "numeric", "Data query (heuristic)").when(r == "what", "Knowledge query (heuristic)")
        .when(r == "none", "Could not determine query type")
        .when(r == "hybrid", "Hybrid query (needs both data and document context)")
        .when(r == "data", data_intent).when(r == "knowledge", knowledge_intent)
        .when(r == "tie_data", "Data query (tie-breaker)").otherwise("Knowledge query (tie-breaker)"),
    }).drop("_low", "_data", "_know", "_hyb", "_d", "_k", "_h", "_all", "_rule")


def tag_query_spec(df: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """Adds agg, agg_term, outcome, contract, gender, senior, internet, group_by, order_term, descending, row_limit.

    Aggregate words count as whole words, also in the plural. Only questions that rank, list or name a number get a limit. Negative outcomes are looked for before positive ones;
    ``compat`` looks for them after, so that "not churned" reads as positive.
    """
    low = strip(F.lower(text))
    agg = F.lit(None).cast("string")
    for name, words in reversed(AGGREGATE_WORDS.items()):
        pattern = r"\b(?:" + "|".join(words) + r")s?\b"
        agg = F.when(low.rlike(pattern), name).otherwise(agg)
    listing = contains_any(low, LIST_WORDS)
    negative, positive = contains_any(low, NEGATIVE_WORDS), contains_any(low, POSITIVE_WORDS)
    outcome = (
        F.when(positive, "positive").when(negative, "negative")
        if compat else F.when(negative, "negative").when(positive, "positive")
    )
    female, male = F.contains(low, F.lit("female")), low.rlike(r"\bmales?\b")
    gender = F.when(female & ~male, "Female").when(~female & F.contains(low, F.lit("male")), "Male")
    number = F.nullif(F.regexp_extract(low, r"\b(\d+)\b", 1), F.lit("")).try_cast("int")
    top, bottom = contains_any(low, TOP_WORDS), contains_any(low, BOTTOM_WORDS)
    ranked = top | bottom
    limit = (
        F.when(ranked & number.isNotNull(), number)
        .when(listing & ~F.contains(low, F.lit("all")), LIST_LIMIT)
        .when(ranked, TOP_LIMIT)
    )
    group = F.coalesce(_first_of(low, GROUP_WORDS), F.when(female & male, "gender"))
    order = F.when(contains_any(low, SORT_WORDS), F.coalesce(_first_of(low, ORDER_TERMS), F.lit("total")))
    tagged = df.withColumns({
        "agg": F.when(~listing, agg), "outcome": outcome,
        "contract": _first_of(low, VALUE_WORDS["contract"]), "gender": gender,
        "senior": F.contains(low, F.lit("senior")), "internet": _first_of(low, VALUE_WORDS["internet"]),
        "_group": group, "_order": order, "_term": _first_of(low, AGGREGATE_TERMS),
        "descending": top | ~bottom, "row_limit": limit.cast("int"),
    })
    return tagged.withColumns({
        "agg_term": F.when(F.col("agg") != "COUNT", F.col("_term")),
        "group_by": F.when(F.col("agg").isNotNull(), F.col("_group")),
        # a single aggregate value has nothing to sort
        "order_term": F.when(F.col("agg").isNull(), F.col("_order")),
    }).drop("_group", "_order", "_term")


def spec_of(tags: Row, df: DataFrame, target: str, aliases: dict = COLUMN_ALIASES) -> QuerySpec:
    """The query one tagged question asks of ``df``; unresolved words are left out."""
    def column(term: str | None) -> str | None:
        return resolve_term(df.columns, term, aliases) if term else None

    filters = []
    if tags["outcome"]:
        hit = target_flag(df, target)
        filters.append(hit if tags["outcome"] == "positive" else ~hit)
    for word in ("contract", "gender", "internet"):
        if tags[word] and column(word):
            filters.append(F.col(column(word)) == tags[word])
    if tags["senior"] and column("senior"):
        filters.append(target_flag(df, column("senior")))
    group = column(tags["group_by"])
    value = None
    if tags["agg"] and tags["agg"] != "COUNT":
        value = column(tags["agg_term"]) or column("monthly")
    return QuerySpec(
        filters=tuple(filters), agg=tags["agg"], column=value, group_by=(group,) if group else (),
        order_by=column(tags["order_term"]), desc=tags["descending"], limit=tags["row_limit"],
    )


def tag_needs(
    df: DataFrame, text: str, has_documents: bool = True, has_data: bool = True, has_model: bool = False
) -> DataFrame:
    """Adds the four need flags and ``steps``, the named steps that serve them in order."""
    low = F.lower(text)
    flagged = df.withColumns({name: contains_any(low, words) for name, words in NEED_WORDS.items()})

    def says(*words: str) -> Column:
        return contains_any(low, words)

    ml = F.col("needs_ml") & F.lit(has_data)
    chart = F.col("needs_chart") & F.lit(has_data)
    table = {
        "rag_answer": F.col("needs_documents") & F.lit(has_documents),
        "sql_query": F.col("needs_data") & F.lit(has_data),
        "ml_train": ml & F.lit(not has_model),
        "ml_batch_predict": ml & says("predict"),
        "ml_feature_importance": ml & says("feature", "importance"),
        "chart_distribution": chart & says("distribution", "churn"),
        "chart_by_category": chart & says("category", "breakdown"),
        "chart_feature_importance": chart & says("feature") & F.lit(has_model),
    }
    steps = F.filter(F.array(*[F.when(on, step) for step, on in table.items()]), lambda s: s.isNotNull())
    return flagged.withColumn("steps", F.when(F.size(steps) == 0, F.array(F.lit("data_stats"))).otherwise(steps))
