"""Column functions on statistics: ratios, formats, guarded logarithms, p-values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNIFICANT = 0.05


def chance_corrected(value: Column, best: Column, chance: float = 0.5) -> Column:
    """(value - chance) / (best - chance); NULL unless best is above chance."""
    return F.when(best > chance, (value - chance) / (best - chance))


def retention(value: Column, best: Column) -> Column:
    return F.when(best > 0, value / best)


def percent(value: Column, limit: float = 1.0) -> Column:
    """The share in percent with one decimal; a value beyond the limit fails the query, as it is in percent already."""
    checked = F.when((value < -limit - 1e-9) | (value > limit + 1e-9), F.raise_error(F.concat(F.lit("no share: "), value.cast("string"))).cast("double")).otherwise(value)
    return F.round(checked * 100.0, 1)


def effective_p(adjusted: Column, raw: Column) -> Column:
    return F.coalesce(adjusted, raw, F.lit(1.0))


def log10_positive(value: Column) -> Column:
    """Base-10 logarithm; NULL at zero and below."""
    return F.when(value > 0, F.log10(value))


def finite(value: Column) -> Column:
    """The value, NULL if it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def pair_kind(objective_a: Column, objective_b: Column, family_a: Column, family_b: Column) -> Column:
    return F.when(objective_a == objective_b, "same_objective").when(family_a == family_b, "within_family").otherwise("across_family")
