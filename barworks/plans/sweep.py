"""A whole parameter grid over many instruments as one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barworks.operators.bars import average_spread, resample, trading_days
from barworks.operators.features import bracket, signal_key
from barworks.operators.indicators import indicator_frame, needs_of
from barworks.operators.ordered import join_per_key
from barworks.operators.outcomes import (
    close_based_exit,
    TouchIndex,
    ladder_outcomes,
    pnl_columns,
    select_non_overlapping,
    touch_index,
)
from barworks.operators.segments import SEGMENT
from barworks.operators.stats import run_metrics
from barworks.operators.votes import Vote, signals
from barworks.plans.arms import Arm, arms_frame, check_arms, first_of_config, table_of
from barworks.session import materialize


@dataclass(frozen=True)
class SweepResult:
    arms: DataFrame
    trades: DataFrame
    metrics: DataFrame


def entries(
    frame: DataFrame,
    arms: list[Arm],
    closes: TouchIndex | None = None,
    entry_fill: str = "next_close",
    gate_exit: str = "close",
    extra: list[Vote] | None = None,
) -> DataFrame:
    """The signals that are actually taken, per distinct entry config and direction.

    With ``gate_exit="close"`` a new entry waits for the close-based exit of the one before, and a
    position that never closes that way is dropped and takes nothing after it. The exit levels use
    the ATR of the entry bar; ``"close_current_atr"`` measures them with the ATR of the bar that is
    looked at. With ``"none"`` every signal is an event of its own.
    """
    if gate_exit not in ("close", "close_current_atr", "none"):
        raise ValueError("gate_exit must be 'close', 'close_current_atr' or 'none'")
    found = signals(frame, arms, entry_fill, extra).withColumns(
        {
            "stop_dist": F.col("stop_atr") * F.col("entry_atr"),
            "target_dist": F.col("target_atr") * F.col("entry_atr"),
        }
    )
    if gate_exit == "none":
        return found
    if gate_exit == "close_current_atr":
        exits = _moving_exit(found, frame, arms)
    else:
        if closes is None:
            closes = touch_index(frame).on_close()
        exits = close_based_exit(found, closes)
    gated = materialize(exits.withColumn("_free", F.col("gate_idx") + 1))
    taken = select_non_overlapping(gated, ["epic", "entry_id", "direction"], "signal_idx", "_free")
    return taken.where(F.col("gate_idx").isNotNull()).drop("_free")


def _moving_exit(found: DataFrame, frame: DataFrame, arms: list[Arm]) -> DataFrame:
    """Close-based exits whose distances follow the ATR of each later bar.

    A long closes where close + stop * ATR falls to the entry price or close - target * ATR rises to
    it; a short the other way round. Each pair of multiples is therefore one series of bars that is
    searched for the entry price itself.
    """
    pairs = sorted(
        {
            (a.atr_period, *multiples)
            for a in arms
            for multiples in ((a.stop_atr, a.target_atr), (a.target_atr, a.stop_atr))
        }
    )
    periods = sorted({n for n, *_ in pairs})
    atrs = "array(" + ", ".join(f"struct({n} AS atr_period, atr_{n} AS atr)" for n in periods) + ")"
    spans = table_of(
        frame.sparkSession,
        [{"atr_period": n, "up": up, "down": down, "_gate": i} for i, (n, up, down) in enumerate(pairs)],
        "atr_period int, up double, down double, _gate int",
    )
    moving = (
        frame.selectExpr("epic", "idx", "end_ts", "c", f"inline({atrs})")
        .join(spans, "atr_period")
        .selectExpr("epic", "idx", "end_ts", "c", "_gate", "c + up * atr AS lo", "c - down * atr AS hi")
    )
    index = touch_index(moving, ("epic", "_gate"), low="lo", high="hi", close="c")
    mine = "direction = 'LONG'"
    events = found.withColumns(
        {
            "up": F.expr(f"CASE WHEN {mine} THEN stop_atr ELSE target_atr END"),
            "down": F.expr(f"CASE WHEN {mine} THEN target_atr ELSE stop_atr END"),
        }
    )
    events = events.join(spans, ["atr_period", "up", "down"]).drop("up", "down")
    return close_based_exit(events, index, moving=True).drop("_gate")


def outcomes(taken: DataFrame, index: TouchIndex, arms: list[Arm]) -> DataFrame:
    """Trades of every arm: entries fanned out to the ladders that share them, then resolved."""
    plans = [
        {
            "entry_id": entry_id,
            "arm_id": i,
            "_tiers": [{"fraction": t.fraction, "target_atr": t.target_atr} for t in arm.exit_ladder],
            "ratchet": arm.ratchet,
        }
        for i, (arm, entry_id) in enumerate(zip(check_arms(arms), first_of_config(arms)))
    ]
    schema = "entry_id int, arm_id int, _tiers array<struct<fraction: double, target_atr: double>>, ratchet string"
    distance = "transform(_tiers, t -> struct(t.fraction AS fraction, t.target_atr * entry_atr AS dist)) AS ladder"
    wide = ["volatility_regime", "reasons", "features"]
    own = ["entry_id", "epic", "direction", "signal_idx"]
    fanned = taken.drop(*wide).join(table_of(taken.sparkSession, plans, schema), "entry_id").selectExpr("*", distance).drop("_tiers")
    rounds = max(len(a.exit_ladder) for a in arms)
    # Only what the search needs goes through it; the rest of a signal is joined back once.
    resolved = ladder_outcomes(fanned, index, rounds).join(taken.select(*own, *wide), own)
    stop, target = bracket(
        F.col("direction"), F.col("entry_price"), F.col("entry_atr"), F.col("stop_atr"), F.col("target_atr")
    )
    stop_sig, target_sig = bracket(
        F.col("direction"),
        F.col("entry_price"),
        F.col("features.atr_value"),
        F.col("stop_atr"),
        F.col("target_atr"),
    )
    return pnl_columns(resolved).withColumns(
        {
            "stop_price": stop,
            "target_price": target,
            "stop_price_signal_atr": stop_sig,
            "target_price_signal_atr": target_sig,
            "signal_key": signal_key(F.col("epic"), F.col("entry_ts"), F.col("direction")),
            "votes_fired": F.array_join("reasons", "+"),
        }
    )


def sweep_bars(
    bars: DataFrame,
    arms: list[Arm],
    avg_spread: Column | DataFrame,
    entry_fill: str = "next_close",
    gate_exit: str = "close",
    segment: int = SEGMENT,
    per_instrument: bool = False,
) -> SweepResult:
    """Evaluate all arms over stored, indexed bars.

    Indicators are computed once for all arms; only bars that fire move on. ``avg_spread`` is a
    column or a table (epic, avg_spread).
    """
    check_arms(arms)
    index = touch_index(bars)
    frame = indicator_frame(bars, needs_of(arms, bands=False), size=segment)
    taken = entries(frame, arms, index.on_close(), entry_fill, gate_exit)
    trades = outcomes(taken, index, arms)
    labels = arms_frame(bars.sparkSession, arms)
    if isinstance(avg_spread, DataFrame):
        trades = join_per_key(trades, avg_spread.select("epic", "avg_spread"), ["epic"], "left")
        spread = F.coalesce("avg_spread", F.lit(0.0))
    else:
        spread = avg_spread
    trades = join_per_key(
        trades.withColumn("net_pnl", F.col("pnl") - spread), labels.select("arm_id", "label"), ["arm_id"]
    )
    trades = materialize(trades.drop("avg_spread"))
    keys = ["label", "epic"] if per_instrument else ["label"]
    order = ["entry_ts", "direction", "signal_key"]
    # Arms without trades are listed with zeros; instruments without trades are not multiplied in.
    metrics = run_metrics(
        trades, keys, order, all_keys=None if per_instrument else labels.select("label")
    )
    dates = F.to_date("end_ts").alias("_date")
    if per_instrument:
        metrics = metrics.join(trading_days(bars), "epic", "left")
    else:
        days = bars.select(dates).distinct().agg(F.count(F.lit(1)))
        metrics = metrics.withColumn("trading_days", days.scalar())
    metrics = metrics.withColumn(
        "trades_per_day", F.coalesce(F.try_divide("trades", "trading_days"), F.lit(0.0))
    )
    return SweepResult(labels, trades, metrics)


def sweep_quotes(quotes: DataFrame, minutes: int, arms: list[Arm], **options) -> SweepResult:
    """Quotes → bars → all arms. Bars are written once because several stages read them."""
    bars = materialize(resample(quotes, minutes))
    return sweep_bars(bars, arms, average_spread(quotes), **options)


def sweep_windows(
    quotes: DataFrame, minutes: int, arms: list[Arm], windows: dict[str, tuple], **options
) -> DataFrame:
    """Metrics of all arms per named window (``{"IS": (start, end), "OOS": (start, end)}``).

    Windows are half open. Each starts its indicators afresh, so nothing of one window reaches
    another. The result is what the window comparison and the promotion gate take.
    """
    ts = F.col("snapshot_time_utc")
    parts = []
    for name, (start, end) in windows.items():
        inside = (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))
        metrics = sweep_quotes(quotes.where(inside), minutes, arms, **options).metrics
        parts.append(metrics.withColumn("window", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
