"""Rounding, clipping and the fixed banding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding on the decimal value, so that 2.675 gives 2.68 whatever the float noise."""
    exact = F.round(value.try_cast("decimal(38,8)"), digits).cast("double")
    # what the decimal cannot hold has no digits behind the point
    return F.coalesce(exact, F.when(F.abs(value.cast("double")) >= 1e29, F.round(value.cast("double"), digits)))


def share_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """``100 * part / whole``, NULL for an empty whole."""
    return round_to(F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double")), digits)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


# Cut points and labels of the banding rules.
RISK_HIGH, RISK_MEDIUM = 0.7, 0.4
RATE_HIGH, RATE_MEDIUM = 30.0, 20.0
Z_HIGH, Z_MEDIUM = 4.0, 3.5
FOREST_HIGH, FOREST_MEDIUM = -0.3, -0.1
RECOMMENDATIONS = {
    "HIGH": "HIGH RISK: Immediate retention action needed. Consider loyalty discount or personal outreach.",
    "MEDIUM": "MEDIUM RISK: Monitor customer satisfaction and engagement. Consider proactive outreach.",
    "LOW": "LOW RISK: Customer appears satisfied. Continue current service.",
}


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability >= RISK_HIGH, "HIGH")
        .when(probability >= RISK_MEDIUM, "MEDIUM")
        .otherwise("LOW")
    )


def recommendation(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RECOMMENDATIONS.items() for x in pair])
    return F.element_at(table, level)


def rate_band(rate: Column) -> Column:
    return (
        F.when(rate >= RATE_HIGH, "high")
        .when(rate >= RATE_MEDIUM, "medium")
        .otherwise("low")
    )


def severity_z(z: Column) -> Column:
    return F.when(z > Z_HIGH, "high").when(z > Z_MEDIUM, "medium").otherwise("low")


def severity_forest(score: Column) -> Column:
    return F.when(score < FOREST_HIGH, "high").when(score < FOREST_MEDIUM, "medium").otherwise("low")
