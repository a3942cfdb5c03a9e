"""Column expressions that are safe under ANSI mode and say null where a value is undefined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(c: Column) -> Column:
    """False for null, NaN and infinities."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def all_finite(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in names])


def any_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_close(a: Column, b: Column, atol: float = 1e-10, rtol: float = 1e-12) -> Column:
    """|a - b| <= atol + rtol * |b|, not symmetric in a and b."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation; null if either side is constant or there is no row."""
    varied = (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def hit_rate(y: Column, p: Column, exclude_zero_actual: bool = False) -> Column:
    """Share of rows with the sign right among rows with a prediction other than zero.

    An actual of zero is a miss unless it is excluded; null if no row counts.
    """
    counts = p != 0
    if exclude_zero_actual:
        counts = counts & (y != 0)
    return F.avg(F.when(counts, (F.signum(y) == F.signum(p)).cast("int")))


def nearly_constant(p: Column, limit: float = 1e-6) -> Column:
    return F.stddev_pop(p) < limit


def rounded(c: Column) -> Column:
    """``round(c, 9)`` of a double, to the last bit, mostly without the decimal number that it makes of each value.

    Below 1e4 the product is off by less than 0.01, so away from a half the whole
    number next to it is the right one, and its quotient is the double nearest to it.
    """
    scaled = c * 1e9
    whole = F.rint(scaled)
    return F.when((F.abs(scaled) < 1e13) & (F.abs(scaled - whole) < 0.49), whole / 1e9).otherwise(F.round(c, 9))


def mapped(c: Column, names: dict) -> Column:
    """The value that ``names`` has for each value; null for one that it lacks."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None)


def metrics(y: Column, p: Column, limit: float = 1e-6) -> list[Column]:
    return [
        F.count("*").alias("n"),
        mae(y, p).alias("mae"),
        safe_corr(y, p).alias("prediction_correlation"),
        hit_rate(y, p).alias("directional_hit_rate"),
        nearly_constant(p, limit).alias("predictions_nearly_constant"),
    ]
