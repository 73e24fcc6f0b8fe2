"""Scalar scorers as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0
YEAR = 365.25 * DAY


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column, k: float, centre: float) -> Column:
    """Rising logistic; a negative k falls. Null scores 0."""
    return F.coalesce(1 / (1 + F.exp(-k * (x - centre))), F.lit(0.0))


def linear_grace(x: Column, low: float, high: float, grace: float) -> Column:
    """1 inside [low, high], falling to 0 over grace outside; null 0."""
    gap = F.greatest(F.lit(low) - x, x - F.lit(high), F.lit(0.0))
    return F.when(x.isNull(), 0.0).otherwise(F.greatest(1 - gap / grace, F.lit(0.0)))


def date_grace(low: float, high: float) -> float:
    """Grace of a two-sided date window: half its width, between one and five years."""
    return min(max(0.5 * (high - low), YEAR), 5 * YEAR)


def maturity(rank: Column, low: int, high: int) -> Column:
    gap = F.least(F.abs(rank - low), F.abs(rank - high))
    return F.when(rank.between(low, high), 1.0).when(gap == 1, 0.5).otherwise(0.0)


def popularity_mode(p: Column, niche: bool = False) -> Column:
    return F.when(p.isNull(), 0.0).otherwise(sigmoid(clamp(p), -12.0, 0.40) if niche else sigmoid(clamp(p), 12.0, 0.70))


def reception_mode(r: Column, poor: bool = False) -> Column:
    return sigmoid(r, -0.22, 50.0) if poor else sigmoid(r, 0.22, 70.0)


def first_position(ids: Column, wanted: list[int]) -> Column:
    """1-based place of the first wanted id, null if none."""
    hits = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(wanted), i + 1)), lambda p: p.isNotNull())
    return F.array_min(hits)


def position_preference(ids: Column, wanted: list[int]) -> Column:
    return F.coalesce(F.exp(-(first_position(ids, wanted) - 1) / 1.3), F.lit(0.0))


def position_gate(ids: Column, wanted: list[int]) -> Column:
    at = first_position(ids, wanted)
    return F.when(at == 1, 1.0).when(at == 2, 0.33).otherwise(0.0)


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def zone_cutoffs(size: Column) -> tuple[Column, Column]:
    """Last billing positions of the lead and supporting zones."""
    root = F.sqrt(size.cast("double"))
    lead = F.least(size, F.greatest(F.lit(2), half_even(0.6 * root).cast("int")))
    support = F.least(size, F.greatest(lead + 1, half_even(root).cast("int")))
    return lead, support


def character_default(position: Column, size: Column) -> Column:
    return 1 - (position - 1) / F.greatest(F.lit(1), size - 1)


def character_central(position: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.15 * F.greatest(F.lit(0), position - 2))


def log_cap(x: Column, cap: int) -> Column:
    return clamp(F.log10(F.coalesce(x, F.lit(0)) + 1.0) / F.log10(F.lit(float(cap))))


def geometric(values: Column, floor: float = 0.1) -> Column:
    """Geometric mean of an array with a floor under each value."""
    logs = F.aggregate(F.transform(values, lambda s: F.log(F.greatest(s, F.lit(floor)))), F.lit(0.0), lambda a, x: a + x)
    return F.exp(logs / F.size(values))


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rarity(fraction: Column) -> Column:
    """Weight of a trait by the share of the corpus it matches (steps of .001, .01, .10 and .30)."""
    return F.when(fraction < 0.001, 1.5).when(fraction < 0.01, 1.2).when(fraction < 0.10, 1.0).when(fraction < 0.30, 0.75).otherwise(0.5)
