"""Outcome per feature bucket against the baseline.

Buckets are cut at ranks, but no row is numbered. A histogram over cells that follow the order of
(value, tie) counts every cell exactly. A cell that lies inside one bucket goes into it as a whole;
only the few cells that a cut runs through are looked at again, in finer cells, until they are small
enough to be sorted as one array. Where a cell holds a single value, its rows are cut by the tie, so
one dominant value is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barworks.functions.guards import share
from barworks.schemas import SLICE_FEATURES
from barworks.session import materialize

DRAG_POINTS = 0.10
MIN_CONFIDENCE = 0.3
LOG_CELLS = 256  # of the first histogram, per unit of the logarithm
CELLS = 1024  # that a cut cell is divided into
SORTED_ROWS = 1 << 16  # of a cut cell that are sorted as one array
MOST_PASSES = 64
_WORD = 6  # bytes of a tie that become one number


def check_feature(feature: str, allowed: tuple[str, ...] = SLICE_FEATURES) -> str:
    if feature not in allowed:
        raise ValueError(f"unknown feature: {feature}")
    return feature


def checked_buckets(buckets: int) -> int:
    if int(buckets) < 1:
        raise ValueError("at least one bucket")
    return int(buckets)


def unpivot_features(
    trades: DataFrame, keys: list[str], features: list[str], carry: list[str]
) -> DataFrame:
    """Wide trade rows → one row per (trade, feature); nulls and NaN are left out."""
    items = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("v"))
            for name in features
        ]
    )
    rows = trades.select(*keys, *carry, F.explode(items).alias("_f"))
    return rows.select(*keys, *carry, "_f.feature", "_f.v").where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )


MEASURES = {
    "_n": "count(1)", "_wins": "sum(CAST(_win AS BIGINT))", "_sum": "sum(_net)", "_nets": "count(_net)", "_lo": "min(v)", "_hi": "max(v)",
}
# How many characters all ties of a cell have in common.
SAME = "size(filter(sequence(1, least(length(_first), length(_last))), i -> left(_first, i) = left(_last, i)))"
_TOTALS = {"_n": "sum", "_wins": "sum", "_sum": "sum", "_nets": "sum", "_lo": "min", "_hi": "max"}


def _measured(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.expr(sql).alias(name) for name, sql in MEASURES.items()])


def _finer(numeric_tie: bool) -> Column:
    """Cell of a row inside its parent cell, which brings ``_lo``, ``_hi``, ``_first`` and ``_last``:
    even steps of the value, or of the tie where there is one value. The least and the greatest row
    of a parent are never in one cell, unless they are equal."""

    def even(x: str, low: str, high: str) -> str:
        return f"floor(({x} / 2 - {low} / 2) / nullif({high} / 2 - {low} / 2, 0D) * {CELLS})"

    if numeric_tie:
        place = even(
            "CAST(CAST(_tie AS DECIMAL(38, 6)) - CAST(_first AS DECIMAL(38, 6)) AS DOUBLE)", "0D",
            "CAST(CAST(_last AS DECIMAL(38, 6)) - CAST(_first AS DECIMAL(38, 6)) AS DOUBLE)",
        )
    else:
        # The first bytes after what all ties of the parent have in common.
        def word(text: str) -> str:
            part = f"substring(encode(substring({text}, _same + 1, {_WORD}), 'UTF-8'), 1, {_WORD})"
            return f"CAST(conv(rpad(hex({part}), {2 * _WORD}, '0'), 16, 10) AS DOUBLE)"

        place = even(word("_tie"), word("_first"), word("_last"))
    return F.expr(f"CAST(CASE WHEN _lo < _hi THEN {even('v', '_lo', '_hi')} ELSE {place} END AS BIGINT)")


def _split(hist: DataFrame, keys: list[str], path: list[str]) -> tuple[DataFrame, DataFrame]:
    """(whole, cut): cells inside one bucket with that bucket, and cells that a cut runs through.

    Windows run over the cells of a series, not over its rows. ``_base`` counts the rows before the
    parent cell, ``_per`` those of a bucket.
    """
    parent = Window.partitionBy(*keys, *path[:-1])
    before = parent.orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, -1)
    placed = hist.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = placed.withColumns(
        {"bucket": F.expr("CAST(_base div _per AS INT)"), "_end": F.expr("CAST((_base + _n - 1) div _per AS INT)")}
    )
    return placed.where("bucket = _end").drop("_end"), placed.where("bucket <> _end").drop("_end", "bucket")


def _sorted_cells(rows: DataFrame, cells: DataFrame, keys: list[str], path: list[str]) -> DataFrame:
    """Rows of small cut cells with their buckets, by the place in the sorted array of a cell."""
    held = F.sort_array(F.collect_list(F.struct("v", "_tie", "_win", "_net"))).alias("_rows")
    by = [*keys, *path, "_base", "_per"]
    # Lists do not shrink when combined early, so rows are dealt first.
    grouped = rows.join(cells.select(*by), [*keys, *path]).repartition(*by).groupBy(*by).agg(held)
    each = grouped.select(*keys, "_base", "_per", F.posexplode("_rows").alias("_pos", "_row")).select(*keys, "_base", "_per", "_pos", "_row.*")
    placed = each.withColumn("bucket", F.expr("CAST((_base + _pos) div _per AS INT)"))
    return _measured(placed, [*keys, "bucket"])


def cut_rows(rows: DataFrame, keys: list[str], buckets: int, tie: str) -> DataFrame:
    """One row of measures per key and bucket, cut by the order of ``v`` and then ``tie``.

    Every pass writes a histogram; a pass after the first reads the rows of cut cells only, and
    there are at most 2 ``buckets`` of these per key. How often is decided by the largest such cell.
    """
    numeric_tie = dict(rows.dtypes)[tie] != "string"
    work = rows.select(
        *keys, "v", F.col(tie).alias("_tie"), F.coalesce("is_win", F.lit(False)).alias("_win"), F.col("net_pnl").alias("_net"),
        F.floor(F.signum("v") * F.log1p(F.abs("v")) * LOG_CELLS).alias("_cell0"),
    )
    path = ["_cell0"]
    kept = [*keys, "bucket", *_TOTALS]
    hist = materialize(_measured(work, [*keys, *path]))
    per = F.greatest(F.lit(1), F.floor(F.sum("_n").over(Window.partitionBy(*keys)) / buckets)).cast("long")
    whole, cut = _split(hist.withColumns({"_per": per, "_base": F.lit(0).cast("long")}), keys, path)
    done = whole.select(*kept)
    for _ in range(MOST_PASSES):
        largest = cut.agg(F.max("_n")).first()[0]
        if (largest or 0) <= SORTED_ROWS:
            break
        cell = [*keys, *path]
        inside = materialize(work.join(cut.select(*cell, "_base", "_per", "_lo", "_hi"), cell))
        ties = inside.where("_lo = _hi").groupBy(*cell).agg(F.min("_tie").alias("_first"), F.max("_tie").alias("_last"))
        if not numeric_tie:
            ties = ties.withColumn("_same", F.expr(SAME))
        path = [*path, f"_cell{len(path)}"]
        work = inside.join(ties, cell, "left").withColumn(path[-1], _finer(numeric_tie))
        work = materialize(work.drop("_lo", "_hi", "_first", "_last", "_same"))
        hist = materialize(_measured(work, [*keys, *path, "_base", "_per"]))
        work = work.drop("_base", "_per")
        whole, cut = _split(hist, keys, path)
        done = done.unionByName(whole.select(*kept))
    if largest:
        done = done.unionByName(_sorted_cells(work, cut, keys, path).select(*kept))
    return done.groupBy(*keys, "bucket").agg(*[F.expr(f"{how}({name})").alias(name) for name, how in _TOTALS.items()])


def slice_rows(rows: DataFrame, keys: list[str], buckets: int, tie: str) -> DataFrame:
    """Equal-count buckets of ``v`` per key with win share and mean net, and the baseline.

    A bucket holds floor(n / buckets) rows (at least one), and what is left over forms an extra,
    shorter bucket; this is not ``ntile``. ``tie`` (a number or a text) decides the order of equal
    values.
    """
    per_key = Window.partitionBy(*keys)
    cut = cut_rows(rows, keys, buckets, tie).select(
        *keys, "bucket", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_n").alias("trades"), "_wins",
        (F.col("_sum") / F.when(F.col("_nets") > 0, F.col("_nets"))).alias("net_avg_pnl"), (F.col("_wins") / F.col("_n")).alias("win_share"),
    )
    return (
        cut.withColumns(
            {
                "baseline_win": F.sum("_wins").over(per_key) / F.sum("trades").over(per_key),
                "confidence": F.greatest(
                    F.lit(MIN_CONFIDENCE), F.col("trades") / F.max("trades").over(per_key)
                ),
            }
        )
        .withColumns(
            {
                "drag": F.col("win_share") < F.col("baseline_win") - DRAG_POINTS,
                "good": F.col("win_share") >= F.col("baseline_win"),
            }
        )
        .drop("_wins")
    )


def slice_feature(
    trades: DataFrame, feature: str, buckets: int = 5, keys: list[str] | None = None, tie: str = "signal_key"
) -> DataFrame:
    """Slices of one feature per run."""
    return slice_all(trades, [feature], buckets, keys, tie)


def slice_all(
    trades: DataFrame,
    features: list[str] | None = None,
    buckets: int = 5,
    keys: list[str] | None = None,
    tie: str = "signal_key",
) -> DataFrame:
    """Slices of every feature in one job."""
    keys = keys or ["run_id"]
    chosen = [check_feature(name) for name in (features or SLICE_FEATURES)]
    rows = unpivot_features(trades, keys, chosen, [tie, "is_win", "net_pnl"])
    return slice_rows(rows, [*keys, "feature"], checked_buckets(buckets), tie)


def baseline(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        share(F.col("is_win")).alias("baseline_win"), F.count(F.lit(1)).alias("trades")
    )
