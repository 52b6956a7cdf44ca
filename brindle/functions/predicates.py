"""Row predicates: outcome flags, allow-listed comparisons and input screens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import strip

# Spellings of a positive outcome in reports and in model targets.
POSITIVE_LABELS = ("YES", "TRUE", "1", "Y", "CHURNED")
POSITIVE_TARGETS = ("yes", "true", "1", "y", "churned", "left", "departed")

# Name patterns of an outcome column, tried in schema order.
TARGET_PATTERNS = (
    "churn", "attrition", "cancelled", "left", "churned", "departed", "exited",
    "churn_value", "churn_label",
)

# Expressions that mark a text as an injection attempt.
INJECTION_PATTERNS = (
    r";\s*--",
    r";\s*DROP",
    r";\s*DELETE",
    r";\s*UPDATE",
    r";\s*INSERT",
    r";\s*ALTER",
    r";\s*CREATE",
    r";\s*TRUNCATE",
    r"UNION\s+SELECT",
    r"OR\s+1\s*=\s*1",
    r"OR\s+'[^']*'\s*=\s*'[^']*'",
    r"--\s*$",
    r"/\*.*\*/",
)
MAX_QUESTION_CHARS = 10_000
MAX_FIELD_CHARS = 5_000


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def target_flag(df: DataFrame, column: str, positive: tuple[str, ...] = POSITIVE_LABELS) -> Column:
    """Boolean outcome of a text or numeric column; NULL stays false."""
    if isinstance(df.schema[column].dataType, T.StringType):
        hit = F.upper(F.col(column)).isin(*[p.upper() for p in positive])
    elif isinstance(df.schema[column].dataType, T.BooleanType):
        hit = F.col(column)
    else:
        hit = F.col(column) == 1
    return F.coalesce(hit, F.lit(False))


def resolve_target(columns: list[str], patterns: tuple[str, ...] = TARGET_PATTERNS) -> str | None:
    """First column, in schema order, whose name holds one of the patterns."""
    return next((c for c in columns if any(p in c.lower() for p in patterns)), None)


def non_blank(column: Column) -> Column:
    return column.isNotNull() & (column != "")


_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    ">=": lambda c, v: c >= v,
    "LIKE": lambda c, v: c.like(v),
}


def safe_predicate(df: DataFrame, column: str, op: str, value=None) -> Column | None:
    """Condition on an existing column; None for an unknown column, operator or value type."""
    if column.lower() not in {c.lower() for c in df.columns}:
        return None
    op, c = op.upper(), F.col(column)
    if op == "IS NULL":
        return c.isNull()
    if op == "IS NOT NULL":
        return c.isNotNull()
    if op == "IN":
        return c.isin(list(value)) if isinstance(value, (list, tuple)) else None
    if op not in _COMPARE:
        return None
    if value is None:
        return c.isNull()
    return _COMPARE[op](c, value) if isinstance(value, (str, int, float)) else None


def safe_select(
    df: DataFrame, columns: list[str], conditions: list[Column | None] = (),
    order_by: str | None = None, limit: int | None = None, ties: tuple[str, ...] = (),
) -> DataFrame:
    """Known columns (all when none is known), AND of conditions, one descending sort, a limit only when asked for."""
    names = {c.lower() for c in df.columns}
    kept = [c for c in columns if c.lower() in names] or df.columns
    out = df.filter(all_of([c for c in conditions if c is not None]))
    if order_by and order_by.lower() in names:
        out = out.orderBy(F.desc(order_by), *ties)
    return (out if limit is None else out.limit(limit)).select(*kept)


def _any_injection(body: Column) -> Column:
    """One search per opening; texts without the characters an attack needs skip the slower ones."""
    needs = {";": ";", "--": "--", "'": "'", "/*": r"/\*", "=": "="}
    groups: dict[str, list[str]] = {}
    for pattern in INJECTION_PATTERNS:
        need = next((n for n, mark in needs.items() if mark in pattern), "")
        groups.setdefault(need, []).append(pattern)
    tests = [
        F.contains(body, F.lit(need)) & body.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        for need, patterns in groups.items()
    ]
    return reduce(lambda a, b: a | b, tests)


def injection_verdict(text: Column) -> Column:
    """'empty', 'too_long', 'dangerous' or 'ok'."""
    body = strip(text)
    hit = _any_injection(body)
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(F.length(body) > MAX_QUESTION_CHARS, "too_long")
        .when(hit, "dangerous")
        .otherwise("ok")
    )


def injection_pattern(text: Column) -> Column:
    """1-based position of the first matching pattern, 0 for none."""
    body = strip(text)
    first = F.lit(0)  # only texts with a match are searched pattern by pattern
    for number in range(len(INJECTION_PATTERNS), 0, -1):
        first = F.when(body.rlike("(?i)" + INJECTION_PATTERNS[number - 1]), number).otherwise(first)
    return F.when(_any_injection(body), first).otherwise(0)


def field_screen(value: Column, limit: int = MAX_FIELD_CHARS) -> Column:
    """struct(valid, value): over-long values are refused, the others trimmed."""
    valid = F.coalesce(F.length(value) <= limit, F.lit(True))
    return F.struct(valid.alias("valid"), F.when(valid, strip(value)).alias("value"))
