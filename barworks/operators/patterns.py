"""Two-bar and one-bar candlestick patterns as predicates over lagged columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barworks.operators.segments import Segmented

TREND_BARS = 5  # prior bars whose mean close tells the short trend
LONG_WICK = 2.0  # wick on the signal side, in bodies
SHORT_WICK = 0.5  # wick on the other side, in bodies


def candle_columns(parts: Segmented) -> dict[str, Column]:
    """The six patterns; false wherever the earlier bars do not exist."""
    w = parts.ordered
    o, h, l, c = (F.col(name) for name in "ohlc")
    po, pc = F.lag("o").over(w), F.lag("c").over(w)
    up, down = c > o, c < o
    was_up, was_down = pc > po, pc < po

    body = F.abs(c - o)
    upper = h - F.greatest(o, c)
    lower = F.least(o, c) - l
    prior = F.avg("c").over(w.rowsBetween(-TREND_BARS, -1))

    raw = {
        "bullish_engulfing": was_down & up & (o < F.least(po, pc)) & (c > F.greatest(po, pc)),
        "bearish_engulfing": was_up & down & (o > F.greatest(po, pc)) & (c < F.least(po, pc)),
        "bullish_harami": was_down & up & (o > pc) & (c < po),
        "bearish_harami": was_up & down & (o < pc) & (c > po),
        "hammer": (body > 0) & (lower >= LONG_WICK * body) & (upper <= SHORT_WICK * body) & (c < prior),
        "shooting_star": (body > 0)
        & (upper >= LONG_WICK * body)
        & (lower <= SHORT_WICK * body)
        & (c > prior),
    }
    return {name: F.coalesce(cond, F.lit(False)) for name, cond in raw.items()}
