"""NaN- and zero-safe expressions.

Spark orders NaN above every number and raises on division by zero under ANSI mode, so every
division and comparison on a possibly-NaN column goes through this module.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NaN where the denominator is zero or NaN, null where either side is null."""
    return F.when(den.isNull() | num.isNull(), F.lit(None).cast("double")).when(
        (den != 0) & ~F.isnan(den), num / F.when(den != 0, den)
    ).otherwise(nan())


def below(a: Column, b: Column) -> Column:
    """``a < b``; false when either side is NaN or null."""
    return F.coalesce((a < b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def at_most(a: Column, b: Column) -> Column:
    return F.coalesce((a <= b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def above(a: Column, b: Column) -> Column:
    return below(b, a)


def at_least(a: Column, b: Column) -> Column:
    return at_most(b, a)


def share(condition: Column) -> Column:
    """Aggregate: share of rows where ``condition`` holds (null condition counts as false)."""
    return F.avg(F.coalesce(condition.cast("double"), F.lit(0.0)))


def sql_below(a: str, b: str) -> str:
    """SQL text of :func:`below`."""
    return f"coalesce({a} < {b} AND NOT isnan({a}) AND NOT isnan({b}), false)"


def sql_at_most(a: str, b: str) -> str:
    return f"coalesce({a} <= {b} AND NOT isnan({a}) AND NOT isnan({b}), false)"


def sql_ratio(num: str, den: str) -> str:
    """SQL text of :func:`ratio`."""
    return f"CASE WHEN {den} = 0 OR isnan({den}) THEN double('NaN') ELSE ({num}) / ({den}) END"
