"""Numeric column helpers shared by the score formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(value: Column) -> Column:
    """Limit a value to [0, 1]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def weighted(terms: list[tuple[float, Column]]) -> Column:
    """Sum of weight x value, added left to right so every run gives the same double."""
    total: Column | None = None
    for weight, value in terms:
        part = F.lit(weight) * value
        total = part if total is None else total + part
    return total


def exp_score(distance: Column, scale: float) -> Column:
    """exp(-max(0, distance) / scale)."""
    return F.exp(-F.greatest(F.lit(0.0), distance) / F.lit(scale))


def signed_corr01(a: Column, b: Column) -> Column:
    """Pearson correlation of two equally long arrays mapped to [0, 1].

    0.25 when an array has fewer than four values, 0.35 when one of them is flat.
    """
    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    def centred(values: Column) -> Column:
        # The one-element array binds the mean once per row instead of once per value.
        return F.transform(F.array(mean(values)), lambda m: F.transform(values, lambda x: x - m))[0]

    a0, b0 = centred(a), centred(b)
    norm = F.sqrt(dot(a0, a0)) * F.sqrt(dot(b0, b0))
    return (
        F.when((F.size(a) < 4) | (F.size(b) < 4), F.lit(0.25))
        .when(norm < 1e-6, F.lit(0.35))
        .otherwise(clamp01((dot(a0, b0) / norm + 1.0) * 0.5))
    )
