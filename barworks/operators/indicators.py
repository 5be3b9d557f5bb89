"""Indicator columns for a set of arms, all from one segmented pass over the bars."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barworks.functions.guards import sql_ratio
from barworks.operators.patterns import TREND_BARS, candle_columns
from barworks.operators.segments import (
    SEGMENT,
    Recurrence,
    Segmented,
    cut,
    ema_alpha,
    segment_size,
    smooth,
    wilder_alpha,
)

ATR_RANK_BARS = 100
REGIME_BARS = 20
REGIME_LOW, REGIME_HIGH = 0.2, 0.8
SLOPE_BARS = 10


@dataclass(frozen=True)
class Needs:
    """The distinct periods a set of arms asks for; each becomes one column."""

    ema: frozenset[int] = frozenset()
    rsi: frozenset[int] = frozenset()
    rsi_sma: frozenset[tuple[int, int]] = frozenset()
    atr: frozenset[int] = frozenset()
    bands: frozenset[tuple[int, float]] = frozenset()
    deviations: frozenset[int] = frozenset()  # mean and deviation without band columns
    swing: frozenset[int] = frozenset()
    volume: frozenset[int] = frozenset()
    sma: frozenset[int] = frozenset()
    candles: bool = True
    context: bool = True  # regime, rank, slope and the next bar's values
    band_ddof: int = field(default=0)

    @property
    def band_periods(self) -> list[int]:
        return sorted({n for n, _ in self.bands} | self.deviations)

    @property
    def lookback(self) -> int:
        frames = [2, TREND_BARS + 1]
        frames += [*self.band_periods, *self.volume, *self.sma]
        frames += [n + 1 for n in self.swing]
        frames += [s for _, s in self.rsi_sma]
        if self.context:
            frames += [ATR_RANK_BARS, REGIME_BARS, SLOPE_BARS + 1]
        return max(frames)


def needs_of(arms, bands: bool = True) -> Needs:
    """What a set of arms asks for. Without ``bands`` their multipliers get no columns, as signals
    use the mean and the deviation alone."""
    arms = list(arms)
    return Needs(
        ema=frozenset(
            n for a in arms for n in (a.ema_period, a.trend_ema_period) if n > 0
        ),
        rsi=frozenset(a.rsi_period for a in arms),
        rsi_sma=frozenset((a.rsi_period, a.rsi_smooth_period) for a in arms),
        atr=frozenset(a.atr_period for a in arms),
        bands=frozenset((a.bb_period, a.bb_multiplier) for a in arms if bands),
        deviations=frozenset(a.bb_period for a in arms),
        swing=frozenset(max(1, a.swing_lookback_bars) for a in arms),
        volume=frozenset(a.volume_sma_period for a in arms),
    )


def band_name(side: str, period: int, multiplier: float) -> str:
    return f"bb_{side}_{period}_{format(multiplier, 'g').replace('.', 'p')}"


def true_range(parts: Segmented) -> Column:
    prev = F.lag("c").over(parts.ordered)
    return F.greatest(
        F.col("h") - F.col("l"), F.abs(F.col("h") - prev), F.abs(F.col("l") - prev)
    )


def rsi_value(gain: Column, loss: Column) -> Column:
    """From smoothed gains and losses: 100 with gains only, 0 without any move."""
    flat = F.when(gain > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    strength = gain / F.when(loss != 0, loss)
    return F.when(loss == 0, flat).otherwise(100.0 - 100.0 / (1.0 + strength))


def percentile_rank(frame: Column, current: Column) -> Column:
    """Share of the frame at or below the current value."""
    return F.size(F.filter(frame, lambda x: x <= current)) / F.size(frame)


def volatility_regime(frame: Column, current: Column) -> Column:
    """LOW at or below the 20th, else HIGH at or above the 80th nearest-lower percentile."""
    ordered = F.sort_array(frame)

    def at(p: float) -> Column:
        return F.element_at(ordered, (F.floor((F.size(frame) - 1) * F.lit(p)) + 1).cast("int"))

    return (
        F.when(current <= at(REGIME_LOW), F.lit("LOW"))
        .when(current >= at(REGIME_HIGH), F.lit("HIGH"))
        .otherwise(F.lit("NORMAL"))
    )


def indicator_frame(
    bars: DataFrame, needs: Needs, keys: tuple[str, ...] = ("epic",), size: int = SEGMENT
) -> DataFrame:
    """Bars plus one column per requested indicator.

    Window frames never leave a segment, so the job is one shuffle on (series, segment) plus a
    join with one carry row per segment.
    """
    recurrences = [Recurrence(f"ema_{n}", "c", ema_alpha(n)) for n in sorted(needs.ema)]
    for n in sorted(needs.rsi):
        recurrences += [
            Recurrence(f"gain_{n}", "_gain", wilder_alpha(n)),
            Recurrence(f"loss_{n}", "_loss", wilder_alpha(n)),
        ]
    recurrences += [Recurrence(f"atr_{n}", "tr", wilder_alpha(n)) for n in sorted(needs.atr)]

    lookback = needs.lookback
    parts = cut(bars, keys, lookback, segment_size(lookback, size))
    change = F.coalesce(F.col("c") - F.lag("c").over(parts.ordered), F.lit(0.0))
    base: dict[str, Column] = {}
    if needs.rsi:
        base["_gain"] = F.greatest(change, F.lit(0.0))
        base["_loss"] = F.greatest(-change, F.lit(0.0))
    if needs.atr:
        base["tr"] = true_range(parts)
    if base:
        parts = parts.with_frame(parts.frame.withColumns(base))
    parts = smooth(parts, recurrences)

    frames: dict[str, Column] = {}
    for n in sorted(needs.sma):
        frames[f"sma_{n}"] = F.avg("c").over(parts.last(n))
    for n in needs.band_periods:
        frames[f"bb_mid_{n}"] = F.avg("c").over(parts.last(n))
        deviation = F.stddev_samp if needs.band_ddof else F.stddev_pop
        frames[f"bb_dev_{n}"] = F.coalesce(deviation("c").over(parts.last(n)), F.lit(0.0))
    for n in sorted(needs.swing):
        frames[f"lowest_{n}"] = F.min("c").over(parts.last(n))
        frames[f"highest_{n}"] = F.max("c").over(parts.last(n))
        prior = parts.ordered.rowsBetween(-n, -1)
        frames[f"prior_low_{n}"] = F.min("c").over(prior)
        frames[f"prior_high_{n}"] = F.max("c").over(prior)
    for n in sorted(needs.volume):
        frames[f"volume_sma_{n}"] = F.avg("volume").over(parts.last(n))
    if needs.candles:
        frames.update(candle_columns(parts))
    for n in sorted(needs.rsi):
        frames[f"rsi_{n}"] = rsi_value(F.col(f"gain_{n}"), F.col(f"loss_{n}"))
    if needs.context:
        for n in sorted(needs.atr):
            rank_frame = F.collect_list(f"atr_{n}").over(parts.last(ATR_RANK_BARS))
            frames[f"atr_rank_{n}"] = percentile_rank(rank_frame, F.col(f"atr_{n}"))
            regime_frame = F.collect_list(f"atr_{n}").over(parts.last(REGIME_BARS))
            frames[f"regime_{n}"] = volatility_regime(regime_frame, F.col(f"atr_{n}"))
        for n in sorted(needs.ema):
            back = F.first(f"ema_{n}").over(parts.last(SLOPE_BARS + 1))
            frames[f"ema_move_{n}"] = F.col(f"ema_{n}") - back
    parts = parts.with_frame(parts.frame.withColumns(frames))

    late: dict[str, Column] = {}
    for n, k in sorted(needs.bands):
        late[band_name("lower", n, k)] = F.col(f"bb_mid_{n}") - F.col(f"bb_dev_{n}") * k
        late[band_name("upper", n, k)] = F.col(f"bb_mid_{n}") + F.col(f"bb_dev_{n}") * k
    for n, s in sorted(needs.rsi_sma):
        late[f"rsi_sma_{n}_{s}"] = F.avg(f"rsi_{n}").over(parts.last(s))
    if needs.context:
        # The bar after: where an entry decided on this bar is filled.
        following = ["o", "c", "end_ts"]
        following += [f"atr_{n}" for n in sorted(needs.atr)]
        following += [f"regime_{n}" for n in sorted(needs.atr)]
        for name in following:
            late[f"next_{name}"] = F.lead(name).over(parts.ordered)
    out = parts.with_frame(parts.frame.withColumns(late)).own_rows()
    return out.drop(
        "_gain",
        "_loss",
        *[f"bb_dev_{n}" for n in needs.band_periods if n not in needs.deviations],
        *[f"{side}_{n}" for n in needs.rsi for side in ("gain", "loss")],
    )


def trend_slope(move: str, idx: str, atr: str) -> str:
    """SQL: EMA change per bar over the last 10 bars, in ATR; the span is shorter at the start."""
    return sql_ratio(move, f"(greatest(1L, least({SLOPE_BARS}L, {idx})) * {atr})")


def volume_ratio(sma_period: int) -> str:
    """SQL: volume against its moving average, NaN where that is zero."""
    return sql_ratio("volume", f"volume_sma_{sma_period}")
