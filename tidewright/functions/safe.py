"""Arithmetic that gives null or a stated default where ANSI Spark would raise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def log_return(price: Column, previous: Column) -> Column:
    """ln(price / previous); 0.0 where either is missing or not positive."""
    ok = (price > 0) & (previous > 0)
    return F.coalesce(F.when(ok, F.ln(F.try_divide(price, previous))), F.lit(0.0))


def pct_change(price: Column, previous: Column) -> Column:
    return F.try_divide(price, previous) - F.lit(1.0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null for a constant side or under two pairs (``corr`` raises)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread))


def skew0(x: Column) -> Column:
    """Population skewness; 0.0 under three values or for a constant group."""
    return F.when(F.count(x) < 3, F.lit(0.0)).otherwise(F.coalesce(F.skewness(x), F.lit(0.0)))


def sum0(x: Column) -> Column:
    """Sum with 0.0 for a group of nulls only."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def std0(x: Column) -> Column:
    """Sample deviation with 0.0 for a single value."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def share(predicate: Column) -> Column:
    """Mean of a predicate over its non-null rows."""
    return F.avg(predicate.cast("double"))
