"""Positions and running values over long ordered series, one bounded chunk per task.

A plain ``Window.partitionBy(series)`` sorts a whole series in one task, and one series may hold a
large part of the table. Here the caller names chunk columns that never decrease along the order
(a day, a block of ids). Rows are numbered or summed inside (series, chunk); one summary row per
chunk carries the totals across, so the only per-series window runs over the chunk summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barworks.session import materialize

SALTS = 32


def _named(chunk: list[Column]) -> dict[str, Column]:
    return {f"_chunk{i}": col for i, col in enumerate(chunk)}


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column | str], chunk: list[Column], name: str = "idx"
) -> DataFrame:
    """Add the dense 0-based position of each row within its series."""
    parts = _named(chunk)
    chunked = df.withColumns(parts)
    grain = [*keys, *parts]
    counts = chunked.groupBy(*grain).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*grain).orderBy(*order)) - 1
    return (
        chunked.join(offsets, grain)
        .withColumn(name, (F.col("_off") + local).cast("long"))
        .drop("_off", *parts)
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    chunk: list[Column],
    value: str,
    name: str,
) -> DataFrame:
    """Add the running total of ``value`` within the series, in order."""
    parts = _named(chunk)
    chunked = df.withColumns(parts)
    grain = [*keys, *parts]
    totals = chunked.groupBy(*grain).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*grain, F.coalesce(F.sum("_total").over(before), F.lit(0.0)).alias("_off"))
    inside = (
        Window.partitionBy(*grain).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        chunked.join(carried, grain)
        .withColumn(name, F.col("_off") + F.sum(value).over(inside))
        .drop("_off", *parts)
    )


def running_max_before(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    chunk: list[Column],
    value: Column,
    name: str,
) -> DataFrame:
    """Add the maximum of ``value`` over all earlier rows of the series (null when there is none)."""
    parts = _named(chunk)
    chunked = df.withColumns({**parts, "_v": value})
    grain = [*keys, *parts]
    tops = chunked.groupBy(*grain).agg(F.max("_v").alias("_top"))
    before = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*grain, F.max("_top").over(before).alias("_carry"))
    inside = (
        Window.partitionBy(*grain).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = F.max("_v").over(inside)
    return (
        chunked.join(carried, grain)
        .withColumn(name, F.greatest(F.col("_carry"), local))
        .drop("_carry", "_v", *parts)
    )


def join_per_key(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS, hint: str | None = None
) -> DataFrame:
    """Join rows to a table with one row per key, where one key may own a large part of the rows.

    The table is repeated once per salt and each row picks a salt by its content, so the rows of a
    frequent key meet it in many tasks. A table small enough for Catalyst to broadcast costs the same;
    Catalyst sees neither the salts nor how far a file is compressed, so where the table grows with
    the rows a ``hint`` like "merge" keeps it from the driver.
    """
    others = [c for c in rows.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*(others or keys)), F.lit(salts)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.hint(hint) if hint else copies
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def number_by_value(
    df: DataFrame,
    keys: list[str],
    value: str,
    tie: str,
    tie_chunk: Column,
    name: str = "pos",
    total: str = "n",
    cells: int = 1024,
    part_rows: int = 100_000,
) -> DataFrame:
    """Dense position of each row when the series is ordered by ``value`` and then ``tie``.

    Rows are spread over parts that follow the order. First come cells on a logarithmic scale. A
    cell is then cut evenly between its lowest and highest value, the finer the more rows it has;
    where all its rows share one value it is cut by ``tie_chunk``, which must not decrease along
    ``tie``. A second such cut isolates frequent values inside a cell. Neither one dominant value
    nor a narrow range of values ends up in one task.
    """
    parts = ["_part0"]
    work = df.withColumns(
        {
            "_part0": F.floor(F.signum(value) * F.log1p(F.abs(F.col(value))) * cells),
            "_tie": tie_chunk.cast("long"),
        }
    )
    for level in (1, 2):
        bounds = work.groupBy(*keys, *parts).agg(
            F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_rows")
        )
        work = join_per_key(work, bounds, [*keys, *parts])
        even = F.expr(
            f"floor((`{value}` - _lo) / nullif(_hi - _lo, 0D) * ceil(_rows / {part_rows}D))"
        )
        cut = F.when(F.col("_lo") == F.col("_hi"), F.col("_tie")).otherwise(even.cast("long"))
        parts.append(f"_part{level}")
        work = work.withColumn(parts[-1], cut).drop("_lo", "_hi", "_rows")
        if level == 1:
            # Every step reads the rows again, so they are written once with their first cut.
            work = materialize(work)
    counts = work.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("_n"))
    series = Window.partitionBy(*keys)
    before = series.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        *parts,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(series).alias(total),
    )
    local = F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(value, tie)) - 1
    return (
        work.join(offsets, [*keys, *parts])
        .withColumn(name, (F.col("_off") + local).cast("long"))
        .drop("_tie", "_off", *parts)
    )
