"""One-table query specification and its DataFrame form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.numbers import round_to
from brindle.functions.predicates import all_of
from brindle.functions.text import answer_number, grouped, label_of

# Terms a listing shows, and the words that stand for a column.
LISTING_TERMS = ("customer", "gender", "tenure", "contract", "monthly", "total", "churn")
COLUMN_ALIASES = {
    "customer": ("customer", "customerid", "customer_id", "cust_id"),
    "gender": ("gender", "sex"),
    "senior": ("senior", "senior_citizen", "seniorcitizen", "is_senior"),
    "tenure": ("tenure", "tenure_months", "months", "tenuremonths"),
    "contract": ("contract", "contract_type", "contracttype"),
    "monthly": ("monthly", "monthly_charges", "monthlycharges", "monthly_charge"),
    "total": ("total", "total_charges", "totalcharges", "total_charge", "revenue"),
    "churn": ("churn", "churn_value", "churnvalue", "churned", "is_churn"),
    "internet": ("internet", "internet_service", "internetservice"),
    "payment": ("payment", "payment_method", "paymentmethod", "payment_type"),
    "phone": ("phone", "phone_service", "phoneservice"),
    "partner": ("partner", "has_partner"),
    "dependents": ("dependents", "has_dependents"),
}
# Rows of a ranking and of a listing that names no number.
TOP_LIMIT, LIST_LIMIT = 10, 50
BREAKDOWN_ROWS = 10

AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


@dataclass(frozen=True)
class QuerySpec:
    """Filters (AND), at most one aggregate, group keys, one sort; all rows unless a limit is asked for."""

    columns: tuple[str, ...] = ()
    filters: tuple[Column, ...] = ()
    agg: str | None = None
    column: str | None = None
    group_by: tuple[str, ...] = ()
    order_by: str | None = None
    desc: bool = True
    limit: int | None = None
    ties: tuple[str, ...] = field(default=())


def alias_columns(columns: Sequence[str], aliases: dict = COLUMN_ALIASES) -> dict[str, str]:
    """Word to column: the last matching spelling wins, first column in schema order for each spelling."""
    found = {}
    for word, spellings in aliases.items():
        hits = [next((c for c in columns if s in c.lower()), None) for s in spellings]
        hits = [h for h in hits if h]
        if hits:
            found[word] = hits[-1]
    return found


def resolve_term(columns: Sequence[str], term: str, aliases: dict = COLUMN_ALIASES) -> str | None:
    """Exact name, then alias (substring either way), then column name (substring either way)."""
    term = term.lower().strip()
    for column in columns:
        if column.lower() == term:
            return column
    for word, column in alias_columns(columns, aliases).items():
        if word in term or term in word:
            return column
    return next((c for c in columns if term in c.lower() or c.lower() in term), None)


def listing_columns(df: DataFrame, terms: Sequence[str] = LISTING_TERMS, aliases: dict = COLUMN_ALIASES) -> list[str]:
    resolved = [resolve_term(df.columns, t, aliases) for t in terms]
    kept = list(dict.fromkeys(c for c in resolved if c))
    return kept or df.columns


def result_name(spec: QuerySpec) -> str:
    return "count" if spec.agg == "COUNT" else f"{spec.agg.lower()}_{spec.column}"


def run_spec(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """Filter, then aggregate or list, then sort and limit."""
    rows = df.filter(all_of(list(spec.filters))) if spec.filters else df
    if spec.agg is None:
        if spec.order_by:
            direction = F.desc(spec.order_by) if spec.desc else F.asc(spec.order_by)
            rows = rows.orderBy(direction, *spec.ties)
        rows = rows.limit(spec.limit) if spec.limit else rows
        return rows.select(*(spec.columns or listing_columns(df)))
    if spec.agg == "COUNT":
        value = F.count("*")
    elif spec.column is None:
        raise ValueError(f"{spec.agg} needs a column")
    else:
        value = round_to(AGGREGATES[spec.agg](spec.column), 2)
    name = result_name(spec)
    if not spec.group_by:
        return rows.agg(value.alias(name))
    grouped_rows = rows.groupBy(*spec.group_by).agg(value.alias(name))
    ordered = grouped_rows.orderBy(F.desc(name), *spec.group_by)
    return ordered.limit(spec.limit) if spec.limit else ordered


def format_answer(result: DataFrame, spec: QuerySpec, noun: str = "") -> DataFrame:
    """One sentence for the result of ``run_spec``; a breakdown shows its first ten groups."""
    if spec.agg and spec.group_by:
        name, key = result_name(spec), spec.group_by[0]
        money = "charge" in name
        number = F.format_number(F.col(name), 0) if spec.agg == "COUNT" else grouped(F.col(name), 2)
        line = F.concat(
            F.lit("• "), F.coalesce(F.col(key).cast("string"), F.lit("Unknown")), F.lit(": "),
            F.lit("$" if money and spec.agg != "COUNT" else ""), number,
        )
        first = result.orderBy(F.desc(name), key).limit(BREAKDOWN_ROWS)
        lines = first.agg(
            F.sort_array(F.collect_list(F.struct((-F.col(name)).alias("o"), F.col(key).alias("k"), line.alias("l")))).alias("x")
        )
        body = F.array_join(F.transform("x", lambda s: s["l"]), "\n")
        return lines.select(
            F.when(F.size("x") == 0, "No data found matching your criteria.")
            .otherwise(F.concat(F.lit("Here's the breakdown:\n"), body)).alias("answer")
        )
    if spec.agg == "COUNT":
        shown = F.concat(F.lit("There are **"), F.format_number("count", 0), F.lit(f"**{noun} in the database."))
        return result.select(shown.alias("answer"))
    if spec.agg:
        name = result_name(spec)
        shown = F.concat(
            F.lit(f"The {spec.agg.lower()} {spec.column.replace('_', ' ')} is **"),
            answer_number(spec.column, F.col(name)), F.lit("**"),
        )
        return result.select(shown.alias("answer"))
    pairs = F.array(*[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"• {label_of(c)}: "), F.col(c).cast("string")))
        for c in result.columns
    ])
    single = F.array_join(F.slice(F.filter(pairs, lambda p: p.isNotNull()), 1, BREAKDOWN_ROWS), "\n")
    return result.agg(F.count("*").alias("n"), F.min(single).alias("one")).select(
        F.when(F.col("n") == 0, "No data found matching your criteria.")
        .when(F.col("n") == 1, F.concat(F.lit("Result:\n"), F.col("one")))
        .otherwise(F.concat(F.lit("Found **"), F.col("n").cast("string"),
                            F.lit("** records. Showing the data in the table below.")))
        .alias("answer")
    )


def result_json(result: DataFrame, limit: int | None = None) -> DataFrame:
    """Numbers stay numbers, everything else becomes text; ``limit`` asks for the first rows only."""
    from pyspark.sql import types as T

    shown = [
        F.col(f.name) if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else F.col(f.name).cast("string").alias(f.name)
        for f in result.schema
    ]
    rows = result if limit is None else result.limit(limit)
    return rows.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("row"))
