"""Scalar column helpers shared by the scoring operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def num(c) -> Column:
    """Column as a finite double; null, NaN and infinities read as 0."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.abs(c) < float("inf"), c).otherwise(0.0)


def flag(c) -> Column:
    """Boolean column as 1.0 / 0.0, null as 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


def bounded(c: Column) -> Column:
    """Clamp a finite expression to 0..1; mentions ``c`` once so nesting stays small."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clip01(c: Column) -> Column:
    """Clamp to 0..1; null, NaN and infinities give 0."""
    return bounded(num(c))


def scale_above(c, start: float, full: float) -> Column:
    """0 at or below ``start``, 1 at or above ``full``, linear between."""
    if full <= start:
        return F.lit(0.0)
    return bounded((num(c) - float(start)) / float(full - start))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of parts that are already within 0..1."""
    total = sum(w for _, w in parts)
    if total <= 0:
        return F.lit(0.0)
    return bounded(reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in parts]) / F.lit(float(total)))


def robust_z(value: Column, med: Column, mad: Column, epsilon: float = EPSILON) -> Column:
    return (value - med) / (F.lit(1.4826) * mad + F.lit(epsilon))


def sigmoid(value: Column, midpoint: float, scale: float) -> Column:
    if scale <= 0:
        return F.lit(0.0)
    return clip01(1.0 / (1.0 + F.exp(-(value - midpoint) / scale)))


def smoothed_nll(count: Column, total: Column, cardinality: Column, alpha: float = 1.0) -> Column:
    """Negative log likelihood with additive smoothing."""
    return -F.log((count + alpha) / (total + alpha * F.greatest(F.lit(1), cardinality)))


def ip_prefix(ip: Column) -> Column:
    """First two dotted parts, or the whole value when there are fewer."""
    return F.substring_index(ip, ".", 2)


def money(c, scale: int = 2) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def round_half_up(c: Column, digits: int) -> Column:
    """Round a double by its decimal value, so ties do not hang on binary noise."""
    return F.round(c.cast("decimal(22,12)"), digits).cast("double")
