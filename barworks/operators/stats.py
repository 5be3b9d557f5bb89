"""Statistics over a trade table: headline metrics, drawdown, quarters, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barworks.functions.guards import ratio, share
from barworks.functions.instants import month_label, quarter_label
from barworks.operators.ordered import join_per_key, running_sum


def _hour_of(ts: str) -> list[Column]:
    """Default chunk of a run: the entry hour. Name finer chunks where one hour is very busy."""
    return [F.date_trunc("hour", ts)]


def with_net(trades: DataFrame, avg_spread: Column | float) -> DataFrame:
    """Add ``net_pnl``: pnl less one average spread per round trip. ``is_win`` stays gross."""
    spread = avg_spread if isinstance(avg_spread, Column) else F.lit(float(avg_spread))
    return trades.withColumn("net_pnl", F.col("pnl") - spread)


def zero_where_absent(df: DataFrame, keys: list[str]) -> DataFrame:
    """Zero for nulls of numeric columns; NaN, which a run has of its own, stays."""
    numeric = [c for c, kind in df.dtypes if c not in keys and kind in ("double", "float", "bigint", "int")]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in numeric})


def headline(
    trades: DataFrame,
    keys: list[str],
    trading_days: Column | int | None = None,
    value_per_point: float = 1.0,
    all_keys: DataFrame | None = None,
) -> DataFrame:
    """Counts, rates and means per key in one aggregation.

    Give ``all_keys`` to list keys without trades as well; their metrics are zero.
    """
    measures = [
        F.count(F.lit(1)).alias("trades"),
        share(F.col("pnl") > 0).alias("win_rate"),
        share(F.col("net_pnl") > 0).alias("net_win_rate"),
        F.avg("pnl").alias("avg_pnl"),
        F.avg("net_pnl").alias("net_avg_pnl"),
        F.sum("net_pnl").alias("total_net"),
    ]
    if "hit_t1" in trades.columns:
        measures.append(share(F.col("hit_t1")).alias("hit_t1_rate"))
    if "r_multiple" in trades.columns:
        measures.append(F.avg("r_multiple").alias("avg_r"))
    out = trades.groupBy(*keys).agg(*measures)
    out = out.withColumn("net_avg_value", F.col("net_avg_pnl") * value_per_point)
    if all_keys is not None:
        out = zero_where_absent(all_keys.select(*keys).join(out, keys, "left"), keys)
    if trading_days is not None:
        days = trading_days if isinstance(trading_days, Column) else F.lit(trading_days)
        per_day = F.when(days == 0, F.lit(0.0)).otherwise(F.col("trades") / F.when(days != 0, days))
        out = out.withColumn("trades_per_day", per_day)
    return out


def equity_curve(
    trades: DataFrame, keys: list[str], order: list[str], chunk: list[Column] | None = None
) -> DataFrame:
    """Add ``equity``, the cumulative net in entry order. ``order[0]`` is the entry instant."""
    return running_sum(trades, keys, order, chunk or _hour_of(order[0]), "net_pnl", "equity")


def max_drawdown(
    trades: DataFrame, keys: list[str], order: list[str], chunk: list[Column] | None = None
) -> DataFrame:
    """Largest fall of the cumulative net from its best point so far, which starts at 0.

    Each chunk of a run is reduced to (total, highest, lowest, deepest fall); the few summaries
    of a run are then combined in order.
    """
    parts = {f"_chunk{i}": c for i, c in enumerate(chunk or _hour_of(order[0]))}
    chunked = trades.withColumns(parts)
    grain = [*keys, *parts]
    inside = Window.partitionBy(*grain).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumn("_eq", F.sum("net_pnl").over(inside)).withColumn(
        "_peak", F.max("_eq").over(inside)
    )
    summary = local.groupBy(*grain).agg(
        F.sum("net_pnl").alias("_total"),
        F.max("_eq").alias("_high"),
        F.min("_eq").alias("_low"),
        F.max(F.col("_peak") - F.col("_eq")).alias("_fall"),
    )
    before = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("_off", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    best = F.max(F.col("_off") + F.col("_high")).over(before)
    fall = F.greatest(
        F.col("_fall"),
        F.greatest(F.lit(0.0), best) - (F.col("_off") + F.col("_low")),
        F.lit(0.0),
    )
    return placed.withColumn("_dd", fall).groupBy(*keys).agg(F.max("_dd").alias("max_drawdown"))


def net_by_quarter(trades: DataFrame, keys: list[str], entry_ts: str = "entry_ts") -> DataFrame:
    return trades.groupBy(*keys, quarter_label(F.col(entry_ts)).alias("quarter")).agg(
        F.sum("net_pnl").alias("net"), F.avg("net_pnl").alias("net_mean")
    )


def quarter_summary(trades: DataFrame, keys: list[str], entry_ts: str = "entry_ts") -> DataFrame:
    """Worst quarter by sum and by mean, positive quarters and quarter count per key."""
    return net_by_quarter(trades, keys, entry_ts).groupBy(*keys).agg(
        F.min("net").alias("worst_quarter_net_sum"),
        F.min("net_mean").alias("worst_quarter_net_mean"),
        F.count_if(F.col("net") > 0).alias("positive_quarters"),
        F.count(F.lit(1)).alias("quarters"),
    )


def return_over_drawdown(total_net: Column, drawdown: Column) -> Column:
    """Total net over drawdown; NaN when there was no drawdown."""
    return ratio(total_net, drawdown)


def run_metrics(
    trades: DataFrame,
    keys: list[str],
    order: list[str],
    trading_days: Column | int | None = None,
    all_keys: DataFrame | None = None,
    value_per_point: float = 1.0,
    chunk: list[Column] | None = None,
) -> DataFrame:
    """Every metric of a run in one row: headline, drawdown, quarters and their ratio."""
    out = (
        headline(trades, keys, trading_days, value_per_point, all_keys)
        .join(max_drawdown(trades, keys, order, chunk), keys, "left")
        .join(quarter_summary(trades, keys, order[0]), keys, "left")
    )
    out = zero_where_absent(out, keys)
    return out.withColumn(
        "return_over_drawdown", return_over_drawdown(F.col("total_net"), F.col("max_drawdown"))
    )


def breakdown(trades: DataFrame, keys: list[str], entry_ts: str = "entry_ts") -> DataFrame:
    """Regime, quarter and direction, and a roll-up of month, quarter, year and total, as grouping sets."""
    when = F.col(entry_ts)
    levels = {
        "regime": F.col("volatility_regime"),
        "year": F.year(when).cast("string"),
        "quarter": quarter_label(when),
        "q+dir": F.concat_ws("_", quarter_label(when), "direction"),
        "month": month_label(when),
    }
    parts = {name: f"_l{i}" for i, name in enumerate(levels)}
    # Trades are grouped by all levels first, which keeps the sixfold fan-out off their rows.
    base = trades.groupBy(*keys, *[level.alias(parts[name]) for name, level in levels.items()]).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("pnl") > 0).alias("_wins"), F.sum("net_pnl").alias("_net")
    )
    sets = [[F.col(k) for k in keys], *[[*map(F.col, keys), F.col(part)] for part in parts.values()]]
    out = base.groupingSets(sets, *keys, *parts.values()).agg(
        F.sum("_n").alias("trades"),
        (F.sum("_wins") / F.sum("_n")).alias("win_rate"),
        (F.sum("_net") / F.sum("_n")).alias("net_avg_pnl"),
        *[F.grouping(part).alias(f"{part}_out") for part in parts.values()],
    )
    kind = F.coalesce(*[F.when(F.col(f"{part}_out") == 0, F.lit(name)) for name, part in parts.items()], F.lit("total"))
    return out.select(*keys, kind.alias("breakdown"), F.coalesce(*parts.values()).alias("bucket"), "trades", "win_rate", "net_avg_pnl")


def by_vote_combination(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trades and wins per set of votes, names sorted."""
    combo = F.array_join(F.sort_array("reasons"), " + ")
    return trades.groupBy(*keys, combo.alias("votes")).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins")
    )


def recovered_spread(trades: DataFrame, runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Average spread implied by stored rows: mean pnl less the run's net average."""
    means = trades.groupBy(run_id).agg(F.avg("pnl").alias("_mean"))
    return means.join(runs.select(run_id, "net_avg_pnl"), run_id).select(
        run_id, (F.col("_mean") - F.col("net_avg_pnl")).alias("avg_spread")
    )


def repair_net(trades: DataFrame, runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Recompute ``net_pnl`` from the recovered spread.

    Only ``net_pnl`` changes and it is no input, so running it twice gives the same rows. A run
    without a stored net average keeps its rows as they are.
    """
    spread = recovered_spread(trades, runs, run_id).withColumnRenamed("avg_spread", "_spread")
    fixed = F.coalesce(F.col("pnl") - F.col("_spread"), F.col("net_pnl"))
    return join_per_key(trades, spread, [run_id], "left").withColumn("net_pnl", fixed).drop("_spread")


def title_summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trade count, win percentage and mean R per key, with the one-line title."""
    out = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        (share(F.col("is_win")) * 100).alias("win_pct"),
        F.avg("r_multiple").alias("avg_r"),
    )
    title = F.format_string(
        "%s | Trades %d | Win %.1f%% | Avg R %.2f", F.col(keys[0]).cast("string"), "trades", "win_pct", "avg_r"
    )
    return out.withColumn("title", title)
