"""Named queries over the given tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barworks.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its check, where SQL can say it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(configure(spark), sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles, turn NaN into null and instants into microseconds, for comparison."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind == "double":
            col = F.when(~F.isnan(col), F.round(col, DIGITS) + F.lit(0.0))
        elif kind == "timestamp":
            col = F.unix_micros(col)
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        out.append(col.alias(name))
    return df.select(*out)


def r(expr: str) -> str:
    """SQL: the same rounding as :func:`tidy`."""
    return f"(round(({expr})::DOUBLE, {DIGITS}) + 0.0::DOUBLE)"
