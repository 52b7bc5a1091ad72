"""Guarded rates, tiers and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    """numerator / denominator; `otherwise` where the denominator is zero or either is null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(otherwise))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def unit_interval(text: Column) -> Column:
    """A confidence given as text: a number clamped to [0, 1], anything else 0."""
    return clamp(F.coalesce(text.try_cast("double"), F.lit(0.0)))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return guarded(part, whole) * 100.0


def percent_text(part: Column, whole: Column) -> Column:
    """The percentage with one decimal place and a % sign."""
    return F.format_string("%.1f%%", percent(part, whole))


def tier(score: Column, high: float = 0.50, medium: float = 0.30) -> Column:
    """'high', 'medium' or 'low' by priority score."""
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def confidence_value(name: Column) -> Column:
    """high 1.0, medium 0.6, low 0.3, anything else 0."""
    return F.when(name == "high", 1.0).when(name == "medium", 0.6).when(name == "low", 0.3).otherwise(0.0)


def bucket(x: Column, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the first bound that x is below; the last name beyond all bounds."""
    out = F.when(x < bounds[0], names[0])
    for b, n in zip(bounds[1:], names[1:-1], strict=True):
        out = out.when(x < b, n)
    return out.otherwise(names[-1])


def size_bucket(megabytes: Column) -> Column:
    return bucket(megabytes, (1, 10, 100), ("<1", "1-10", "10-100", ">=100"))


def stars_bucket(stars: Column) -> Column:
    return bucket(stars, (100, 1000, 10000), ("<100", "100-1K", "1K-10K", ">=10K"))


def age_bucket(years: Column) -> Column:
    return bucket(years, (1, 3, 7), ("<1", "1-3", "3-7", ">=7"))


def contributors_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise(">20")


def accuracy_bucket(accuracy: Column) -> Column:
    return F.when(accuracy >= 1.0, "perfect").when(accuracy >= 0.8, "high").when(accuracy >= 0.6, "medium").otherwise("low")


def scheme_name(llm_weight: Column) -> Column:
    """The name of a weight scheme by its weight of the verdict signal, within 0.01."""
    near = lambda v: F.abs(llm_weight - v) < 0.01
    return F.when(near(0.70), "llm_dominant").when(near(0.90), "llm_extreme").when(near(0.30), "balanced").otherwise("custom")
