"""Queries over experiments and runs: listing, lookup, ranking, pooling, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barworks.operators.ordered import join_per_key
from barworks.operators.stats import return_over_drawdown

# The pre-registered promotion gate and the listing limit of losing trades.
MIN_TRADES = 30
MIN_POSITIVE_QUARTERS = 3
WINNER_SHARE = 0.75
LISTING_LIMIT = 40


def rank_arms(metrics: DataFrame) -> DataFrame:
    """Arms by net win rate, best first."""
    return metrics.orderBy(F.desc("net_win_rate"), "label")


def quality_gate(experiments: DataFrame) -> DataFrame:
    """More than 75% winners, every quarter positive on average, and positive net."""
    passed = (
        (F.col("win_rate") > WINNER_SHARE)
        & (F.col("worst_quarter_net_mean") > 0)
        & (F.col("net_avg_pnl") > 0)
    )
    return experiments.where(passed).orderBy(F.desc("net_avg_pnl"), "experiment_id")


def list_experiments(experiments: DataFrame) -> DataFrame:
    return experiments.orderBy("experiment_id")


def find_experiment(experiments: DataFrame, ref: str) -> DataFrame:
    """The latest experiment whose id or label is ``ref``: by ``run_ts``, or by id in tables that
    have no such column."""
    found = (F.col("experiment_id").cast("string") == ref) | (F.col("label") == ref)
    newest = [F.desc(c) for c in ("run_ts", "experiment_id") if c in experiments.columns]
    return experiments.where(found).orderBy(*newest).limit(1)


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "id")


def trades_of(trades: DataFrame, run_id, which: str = "all") -> DataFrame:
    """Trades of one run in entry order, without the bar windows."""
    if which not in ("all", "winners", "losers"):
        raise ValueError("which must be all, winners or losers")
    chosen = trades.where(F.col("run_id") == run_id).drop("bars")
    if which != "all":
        chosen = chosen.where(F.col("is_win") == F.lit(which == "winners"))
    return chosen.orderBy("entry_ts", "signal_key")


def worst_losers(trades: DataFrame, run_id, limit: int) -> DataFrame:
    """The ``limit`` losing trades of a run with the lowest net, a top-k listing."""
    lost = trades.where((F.col("run_id") == run_id) & ~F.col("is_win"))
    return lost.orderBy("net_pnl", "signal_key").limit(limit)


def pool_trades(trades: DataFrame, configs: DataFrame, key: str = "signal_key") -> DataFrame:
    """One row per signal over the experiments that share an entry config.

    Duplicates collapse to the row of the lowest experiment id, by a combinable aggregate.
    """
    hashed = configs.select("experiment_id", F.sha2("entry_config", 256).alias("entry_hash"))
    joined = join_per_key(trades, hashed, ["experiment_id"])
    row = F.struct("experiment_id", *[c for c in trades.columns if c not in ("experiment_id", key)])
    return (
        joined.groupBy("entry_hash", key)
        .agg(F.min(row).alias("_row"), F.count(F.lit(1)).alias("experiments"))
        .select("entry_hash", key, "experiments", "_row.*")
    )


def same_entries(trades: DataFrame, left, right, run: str = "label", key: str = "signal_key") -> DataFrame:
    """Signals that only one of two arms has; empty when the arms share their entries."""
    a = trades.where(F.col(run) == left).select(key)
    b = trades.where(F.col(run) == right).select(key)
    return a.exceptAll(b).withColumn("only_in", F.lit(left)).unionByName(
        b.exceptAll(a).withColumn("only_in", F.lit(right))
    )


def window_label(entry_ts: Column, split: Column) -> Column:
    """In-sample before the split, out-of-sample from it on."""
    return F.when(entry_ts < split, F.lit("IS")).otherwise(F.lit("OOS"))


def compare_windows(metrics: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row per key with each measure in and out of sample and their difference."""
    sides = [
        F.max(F.when(F.col("window") == side, F.col(m))).alias(f"{m}_{side.lower()}")
        for m in measures
        for side in ("IS", "OOS")
    ]
    out = metrics.groupBy(*keys).agg(*sides)
    return out.withColumns({f"{m}_shift": F.col(f"{m}_oos") - F.col(f"{m}_is") for m in measures})


def promotion_gate(metrics: DataFrame, control: str) -> DataFrame:
    """Arms that pass the gate, ranked by out-of-sample total net over drawdown.

    ``metrics`` has one row per (label, window). An arm must beat the control's net per trade and
    not exceed its drawdown out of sample, have at least 30 trades there, and be net positive in
    at least 3 in-sample quarters. No arm passing is a valid result.
    """
    # The table holds one row per arm and window, so windows over it are bounded by the grid size.
    everyone = Window.partitionBy("window")
    own = F.col("label") == control
    oos = metrics.where(F.col("window") == "OOS").withColumns(
        {
            "_net": F.max(F.when(own, F.col("net_avg_pnl"))).over(everyone),
            "_dd": F.max(F.when(own, F.col("max_drawdown"))).over(everyone),
        }
    )
    steady = metrics.where(
        (F.col("window") == "IS") & (F.col("positive_quarters") >= MIN_POSITIVE_QUARTERS)
    ).select("label")
    passed = (
        oos.where(
            (F.col("label") != control)
            & (F.col("net_avg_pnl") > F.col("_net"))
            & (F.col("max_drawdown") <= F.col("_dd"))
            & (F.col("trades") >= MIN_TRADES)
        )
        .join(steady, "label", "left_semi")
        .withColumn("ratio", return_over_drawdown(F.col("total_net"), F.col("max_drawdown")))
    )
    # A missing drawdown (NaN ratio) has no useful rank and comes last.
    order = everyone.orderBy(F.isnan("ratio"), F.desc("ratio"), "label")
    return passed.withColumn("place", F.row_number().over(order)).select(
        "label", "trades", "net_avg_pnl", "max_drawdown", "total_net", "ratio", "place"
    )
