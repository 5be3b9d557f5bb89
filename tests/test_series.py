"""Recurrences and bounded windows over segments."""

import random

import pandas as pd
import pytest

from barworks.operators.indicators import Needs, indicator_frame, needs_of
from barworks.operators.segments import Recurrence, block_size, cut, ema_alpha, segment_size
from barworks.plans.arms import Arm
from tests.helpers import BAR_SCHEMA, bar, random_bars

ARM = Arm(ema_period=9, trend_ema_period=30, enable_structure=True)


@pytest.fixture(scope="module")
def rows():
    return random_bars(900, "A", 11) + random_bars(130, "B", 12)


@pytest.fixture(scope="module")
def plain(spark, rows):
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    return indicator_frame(bars, needs_of([ARM])).toPandas().sort_values(["epic", "idx"]).reset_index(drop=True)


def same(left, right):
    right = right[left.columns].sort_values(["epic", "idx"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(left, right, rtol=1e-9, atol=1e-9, check_dtype=False)


@pytest.mark.parametrize("size", [110, 128, 512])
def test_segment_size_does_not_matter(spark, rows, plain, size):
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    same(plain, indicator_frame(bars, needs_of([ARM]), size=size).toPandas())


def test_rsi_survives_a_flat_stretch(spark):
    """Gains and losses fade together, so their ratio stays where the last move left it."""
    moving = random_bars(40, seed=3)
    last = moving[-1][6]
    bars = spark.createDataFrame([*moving, *[bar("X", i, last, last, last) for i in range(40, 1500)]], BAR_SCHEMA)
    frames = [indicator_frame(bars, needs_of([ARM]), size=size).toPandas().sort_values("idx") for size in (150, 512, 2048)]
    rsi = [c for c in frames[0].columns if "rsi" in c and not c.startswith("next_")]
    assert rsi
    for frame in frames[1:]:
        for name in rsi:
            assert abs(frame[name].to_numpy() - frames[0][name].to_numpy()).max() < 1e-6
            assert frame[name].iloc[-1] > 1


def test_row_order_does_not_matter(spark, rows, plain):
    mixed = rows[:]
    random.Random(0).shuffle(mixed)
    bars = spark.createDataFrame(mixed, BAR_SCHEMA).repartition(7)
    same(plain, indicator_frame(bars, needs_of([ARM]), size=200).toPandas())


def test_nothing_looks_ahead(spark, rows, plain):
    cut_at = 400
    bars = spark.createDataFrame([r for r in rows if r[1] <= cut_at], BAR_SCHEMA)
    early = indicator_frame(bars, needs_of([ARM]), size=150).toPandas()
    own = [c for c in plain.columns if not c.startswith("next_")]
    same(plain.loc[plain.idx <= cut_at, own].reset_index(drop=True), early)


def test_against_pandas(plain):
    for _, g in plain.groupby("epic"):
        c = g.c.reset_index(drop=True)
        close = lambda a, b: (a.reset_index(drop=True) - b).abs().max() < 1e-8
        assert close(g.ema_9, c.ewm(span=9, adjust=False).mean())
        move = c.diff().fillna(0)
        gain = move.clip(lower=0).ewm(alpha=1 / 7, adjust=False).mean()
        loss = (-move).clip(lower=0).ewm(alpha=1 / 7, adjust=False).mean()
        rsi = 100 - 100 / (1 + gain / loss)
        assert close(g.rsi_7.iloc[20:], rsi.iloc[20:].reset_index(drop=True))
        assert close(g.bb_mid_20, c.rolling(20, min_periods=1).mean())
        assert close(g.lowest_10, c.rolling(10, min_periods=1).min())
        rank = g.atr_14.reset_index(drop=True).rolling(100, min_periods=1).apply(lambda w: (w <= w.iloc[-1]).mean())
        assert close(g.atr_rank_14, rank)
        assert g.rsi_7.between(0, 100).all()


def test_period_one_is_the_identity(spark, rows):
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    out = indicator_frame(bars, Needs(ema=frozenset({1}), candles=False, context=False)).toPandas()
    assert (out.ema_1 == out.c).all()


def test_every_bar_comes_out_once(spark, rows):
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    for lookback, size in ((5, 7), (3, 100), (50, 128)):
        assert cut(bars, ("epic",), lookback, size).own_rows().count() == len(rows)


def test_segments_follow_the_frames_alone():
    assert segment_size(100) == 2048 and segment_size(100, 64) == 102 and segment_size(3000) == 3002
    assert block_size(Recurrence("x", "c", ema_alpha(2))) < 1100


@pytest.mark.parametrize("size", [64, 512, 2048])
def test_fast_decays_beside_long_frames(spark, size):
    """EMA(2), RSI(2) and ATR(2) with a frame of 300 bars over a series of several blocks."""
    rows = random_bars(5000, "A", 13) + random_bars(700, "B", 14)
    needs = Needs(ema=frozenset({2, 50}), rsi=frozenset({2}), atr=frozenset({2}), swing=frozenset({300}), candles=False, context=False)
    out = indicator_frame(spark.createDataFrame(rows, BAR_SCHEMA), needs, size=size).toPandas().sort_values(["epic", "idx"])
    for _, g in out.groupby("epic"):
        c, h, low = (g[x].reset_index(drop=True) for x in "chl")
        close = lambda a, b: (a.reset_index(drop=True) - b).abs().max() < 1e-8
        assert close(g.ema_2, c.ewm(span=2, adjust=False).mean()) and close(g.ema_50, c.ewm(span=50, adjust=False).mean())
        reach = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
        assert close(g.atr_2, reach.ewm(alpha=0.5, adjust=False).mean())
        move = c.diff().fillna(0)
        gain, loss = (m.clip(lower=0).ewm(alpha=0.5, adjust=False).mean() for m in (move, -move))
        assert close(g.rsi_2.iloc[9:], (100 - 100 / (1 + gain / loss)).iloc[9:].reset_index(drop=True).set_axis(range(len(g) - 9)))
        assert close(g.lowest_300, c.rolling(300, min_periods=1).min())


def test_flat_prices_have_no_strength(spark):
    flat = [(r[0], r[1], r[2], 5.0, 5.0, 5.0, 5.0, 0.0) for r in random_bars(40)]
    out = indicator_frame(spark.createDataFrame(flat, BAR_SCHEMA), needs_of([ARM])).toPandas()
    assert (out.rsi_7 == 0).all() and (out.atr_14 == 0).all() and not out.hammer.any()
