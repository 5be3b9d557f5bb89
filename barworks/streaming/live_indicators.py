"""EMA, RSI and ATR carried along a live bar stream, one small state per instrument."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from barworks.operators.segments import MAX_EXPONENT, ema_alpha, wilder_alpha

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "epic string, at bigint, tie bigint, c double, ema double, rsi double, atr double, late boolean"
STATE = "at bigint, tie bigint, newest bigint, close double, ema double, gain double, loss double, atr double"
WAITING = "at bigint, tie bigint, h double, l double, c double"
COLUMNS = ["at", "tie", "h", "l", "c"]
MOST_HELD = 10_000  # bars of an instrument; the oldest beyond that are released early


def smoothed(values: np.ndarray, alpha: float, last: float) -> np.ndarray:
    """``y = y + alpha * (x - y)`` along an array, after the value ``last``."""
    decay = 1.0 - alpha
    if decay <= 0.0:
        return values
    out = np.empty(len(values))
    size = max(1, int(MAX_EXPONENT / -math.log(decay)))
    for start in range(0, len(values), size):
        some = values[start : start + size]
        weight = decay ** np.arange(1, len(some) + 1)
        out[start : start + size] = weight * (last + np.cumsum(alpha * some / weight))
        last = out[start + len(some) - 1]
    return out


class LiveIndicators(StatefulProcessor):
    """Holds bars back for ``hold`` microseconds of event time, puts them in order and carries the
    recurrences over them, a whole array at a time."""

    def __init__(self, alphas: tuple[float, float, float], hold: int):
        self.alphas = alphas
        self.hold = hold

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("carried", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[COLUMNS] for r in rows])
        held = self.state.get() if self.state.exists() else None
        newest = max(int(new["at"].max()), held[2] if held else -(2**62))
        if held:
            behind = (new["at"] < held[0]) | ((new["at"] == held[0]) & (new["tie"] <= held[1]))
            if behind.any():
                yield self._rows(key, new[behind], None)
                new = new[~behind]
        if self.hold and self.waiting.exists():
            new = pd.concat([pd.DataFrame(list(self.waiting.get()), columns=COLUMNS), new])
        new = new.sort_values(["at", "tie"], kind="stable")
        ready = (new["at"].to_numpy() <= newest - self.hold) | (np.arange(len(new)) < len(new) - MOST_HELD)
        yield from self._advance(key, new[ready], held, newest)
        if self.hold:
            self._wait(new[~ready], newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the newest bar of a quiet instrument: all it holds is released."""
        held = self.state.get() if self.state.exists() else None
        rows = pd.DataFrame(list(self.waiting.get()), columns=COLUMNS).sort_values(["at", "tie"], kind="stable")
        yield from self._advance(key, rows, held, held[2] if held else int(rows["at"].max()))
        self.waiting.clear()

    def _wait(self, rows: pd.DataFrame, newest: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(rows):
            self.waiting.put([tuple(r) for r in rows.astype(object).itertuples(index=False)])
            self.handle.registerTimer(newest // 1000 + 1)
        else:
            self.waiting.clear()

    def _advance(self, key, bars: pd.DataFrame, held, newest: int) -> Iterator[pd.DataFrame]:
        if not len(bars):
            if held and held[2] != newest:
                self.state.update((*held[:2], newest, *held[3:]))
            return
        high, low, close = (bars[c].to_numpy(dtype=float) for c in ("h", "l", "c"))
        # The first bar of all starts the recurrences: no move, its own range, its own close.
        before = np.concatenate(([held[3] if held else close[0]], close[:-1]))
        reach = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        if not held:
            reach[0] = high[0] - low[0]
        carried = held[4:] if held else (close[0], 0.0, 0.0, reach[0])
        a_ema, a_rsi, a_atr = self.alphas
        move = close - before
        ema = smoothed(close, a_ema, carried[0])
        gain = smoothed(np.maximum(move, 0.0), a_rsi, carried[1])
        loss = smoothed(np.maximum(-move, 0.0), a_rsi, carried[2])
        atr = smoothed(reach, a_atr, carried[3])
        last = bars.iloc[-1]
        ends = tuple(float(x[-1]) for x in (close, ema, gain, loss, atr))
        self.state.update((int(last["at"]), int(last["tie"]), newest, *ends))
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(loss == 0, np.where(gain > 0, 100.0, 0.0), 100.0 - 100.0 / (1.0 + gain / loss))
        yield self._rows(key, bars, (ema, rsi, atr))

    @staticmethod
    def _rows(key, bars: pd.DataFrame, values) -> pd.DataFrame:
        ema, rsi, atr = values or (np.full(len(bars), np.nan),) * 3
        return pd.DataFrame(
            {"epic": key[0], "at": bars["at"].to_numpy(dtype=np.int64), "tie": bars["tie"].to_numpy(dtype=np.int64), "c": bars["c"].to_numpy(dtype=float),
             "ema": ema, "rsi": rsi, "atr": atr, "late": values is None}
        )


def live_indicators(
    bars: DataFrame,
    ema_period: int = 50,
    rsi_period: int = 7,
    atr_period: int = 14,
    hold: str = "0 seconds",
    quiet: str = "1 day",
) -> DataFrame:
    """Bars (epic, end_ts, tie, h, l, c) → (epic, end_ts, tie, c, ema, rsi, atr, late).

    The state is the last value of each recurrence and the bars of the last ``hold`` of event time,
    at most 10,000, which wait for bars that are late. A bar that comes when a later one of its
    instrument is already out is not folded in: it comes out at once with ``late`` set and without
    indicators (:func:`late_bars`). Bars with one end are ordered by ``tie``. The newest bars of an
    instrument that falls silent come out when the stream is ``quiet`` ahead of them, by an
    event-time timer; a bar more than ``quiet`` behind the whole stream is dropped by the watermark.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    micros = bars.sparkSession.sql(f"SELECT CAST(unix_micros(timestamp'1970-01-01 00:00:00Z' + interval '{hold}') AS BIGINT)").first()[0]
    alphas = ema_alpha(ema_period), wilder_alpha(rsi_period), wilder_alpha(atr_period)
    timed = bars.withWatermark("end_ts", quiet).select(
        "epic", "end_ts", F.unix_micros("end_ts").alias("at"), F.col("tie").cast("long").alias("tie"), *[F.col(c).cast("double").alias(c) for c in ("h", "l", "c")]
    )
    out = timed.groupBy("epic").transformWithStateInPandas(LiveIndicators(alphas, micros), OUTPUT, "Append", "EventTime")
    values = [F.when(~F.col("late"), F.col(c)).alias(c) for c in ("ema", "rsi", "atr")]
    return out.select("epic", F.timestamp_micros("at").alias("end_ts"), "tie", "c", *values, "late")


def on_time(rows: DataFrame) -> DataFrame:
    """The bars that were folded in."""
    return rows.where("NOT late").drop("late")


def late_bars(rows: DataFrame) -> DataFrame:
    """The side output: bars that came beyond the bound, as they came."""
    return rows.where("late").select("epic", "end_ts", "tie", "c")
