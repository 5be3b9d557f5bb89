"""Entry features and keys of a trade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from barworks.functions.guards import sql_ratio
from barworks.functions.instants import iso_instant
from barworks.operators.indicators import trend_slope
from barworks.plans.arms import Arm

# What the features of an arm are made of: places in the array of a bar's values.
FEATURE_TERMS = (
    "f_rsi", "f_mid", "f_dev", "f_lowest", "f_highest", "f_trend", "f_move", "f_atr", "f_rank", "f_volume_sma", "f_c", "f_volume", "f_idx",
)


def feature_row(arm: Arm, at: Callable[[str], int]) -> dict:
    """The places of an arm's feature terms and its band multiplier; no trend EMA gives a null place."""
    swing = max(1, arm.swing_lookback_bars)
    slope = arm.trend_ema_period if arm.trend_ema_period > 0 else arm.ema_period
    return {
        "f_rsi": at(f"rsi_{arm.rsi_period}"),
        "f_mid": at(f"bb_mid_{arm.bb_period}"),
        "f_dev": at(f"bb_dev_{arm.bb_period}"),
        "f_lowest": at(f"lowest_{swing}"),
        "f_highest": at(f"highest_{swing}"),
        "f_trend": at(f"ema_{arm.trend_ema_period}") if arm.trend_ema_period > 0 else None,
        "f_move": at(f"ema_move_{slope}"),
        "f_atr": at(f"atr_{arm.atr_period}"),
        "f_rank": at(f"atr_rank_{arm.atr_period}"),
        "f_volume_sma": at(f"volume_sma_{arm.volume_sma_period}"),
        "f_c": at("c"),
        "f_volume": at("volume"),
        "f_idx": at("idx"),
        "band_factor": float(arm.bb_multiplier),
    }


def feature_sql(values: str, score: str, entry_ts: str) -> str:
    """SQL struct with the feature vector of the signal bar; distances are in ATR.

    Everything comes from the array of the signal bar's own values, so nothing later can leak in.
    Hour and weekday are those of the entry bar's end.
    """
    term = {name: f"get({values}, {name})" for name in FEATURE_TERMS}
    atr, c = term["f_atr"], term["f_c"]
    band = f"{term['f_dev']} * band_factor"
    fields = {
        "rsi_value": term["f_rsi"],
        "dist_to_bb_lower_atr": sql_ratio(f"{c} - ({term['f_mid']} - {band})", atr),
        "dist_to_bb_upper_atr": sql_ratio(f"({term['f_mid']} + {band}) - {c}", atr),
        "dist_to_support_atr": sql_ratio(f"{c} - {term['f_lowest']}", atr),
        "dist_to_resistance_atr": sql_ratio(f"{term['f_highest']} - {c}", atr),
        "dist_to_trend_ema_atr": f"CASE WHEN f_trend IS NOT NULL THEN {sql_ratio(f'{c} - ' + term['f_trend'], atr)} END",
        "trend_slope_atr": trend_slope(term["f_move"], term["f_idx"], atr),
        "atr_value": atr,
        "atr_percentile": term["f_rank"],
        "volume_ratio": sql_ratio(term["f_volume"], term["f_volume_sma"]),
        "hour_utc": f"hour({entry_ts})",
        "day_of_week": f"weekday({entry_ts}) + 1",
        "confluence_score": score,
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def signal_key(instrument: Column, entry_ts: Column, direction: Column) -> Column:
    """The key that joins annotations back across reruns."""
    return F.concat_ws("|", instrument, iso_instant(entry_ts), direction)


def bracket(direction: Column, entry_price: Column, atr: Column, stop_atr: Column, target_atr: Column):
    """Stop and target price for an ATR: the entry bar's for outcomes, the signal bar's for display."""
    sign = F.when(direction == "LONG", F.lit(1.0)).otherwise(F.lit(-1.0))
    return entry_price - sign * stop_atr * atr, entry_price + sign * target_atr * atr
