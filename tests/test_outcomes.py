"""Golden outcomes, and searches and selections against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barworks.operators import outcomes as X
from tests.helpers import BAR_SCHEMA, bar, random_bars

THIRD = 1.0 / 3.0
SINGLE = [(1.0, 0.75)]
THIRDS = [(THIRD, 0.75), (THIRD, 1.5), (THIRD, 3.0)]
BE, LAG, NO = "BREAKEVEN_AFTER_T1", "LAGGED", "NONE"

# name, direction, ladder, ratchet, limit, bars after the entry bar as (high, low, close),
# expected: exit index, reason, weighted price, tiers filled
GOLDEN = [
    ("target", "LONG", SINGLE, NO, 0, [(101, 99.5, 100.5)], 1, "TARGET", 100.75, 1),
    ("stop", "LONG", SINGLE, NO, 0, [(100.5, 96, 98)], 1, "STOP", 97.0, 0),
    ("both", "LONG", SINGLE, NO, 0, [(101, 96, 100.5)], 1, "STOP", 97.0, 0),
    ("neither", "LONG", SINGLE, NO, 0, [(100.4, 98.5, 99), (100.6, 98, 99.5)], 2, "END", 99.5, 0),
    ("limit", "LONG", SINGLE, NO, 2, [(100.4, 98.5, 99), (100.6, 98, 99.7), (100.5, 98.2, 99.3)], 2, "TIME", 99.7, 0),
    ("short", "SHORT", SINGLE, NO, 0, [(100.5, 99, 99.5)], 1, "TARGET", 99.25, 1),
    ("all_tiers", "LONG", THIRDS, NO, 0, [(100.8, 99.5, 100.6), (101.6, 100.4, 101.2), (103.2, 101, 103)], 3, "TARGET", 101.75, 3),
    ("two_in_a_bar", "LONG", THIRDS, NO, 0, [(102, 99.8, 101.8)], 1, "END", (100.75 + 101.5 + 101.8) / 3, 2),
    ("stop_and_tiers", "LONG", THIRDS, NO, 0, [(102, 96, 100.5)], 1, "STOP", 97.0, 0),
    ("two_then_stop", "LONG", THIRDS, NO, 0, [(102, 99.8, 101.8), (101.9, 96.5, 97)], 2, "STOP", 99.75, 2),
    ("ladder_limit", "LONG", THIRDS, NO, 2, [(100.8, 99.5, 100.6), (100.9, 99.9, 100.2), (100.9, 99.9, 100.4)], 2, "TIME", (100.75 + 100.2 + 100.2) / 3, 1),
    ("ladder_short", "SHORT", THIRDS, NO, 0, [(100.2, 98.4, 98.6), (98.7, 96.9, 97)], 2, "TARGET", (99.25 + 98.5 + 97) / 3, 3),
    ("full_loss", "LONG", THIRDS, NO, 0, [(100.2, 96.5, 97)], 1, "STOP", 97.0, 0),
    ("stop_after_t1", "LONG", THIRDS, NO, 0, [(100.8, 99.9, 100.6), (100.7, 96.5, 97)], 2, "STOP", (100.75 + 2 * 97) / 3, 1),
    ("breakeven", "LONG", THIRDS, BE, 0, [(100.8, 99.9, 100.6), (100.7, 99.5, 99.6)], 2, "STOP", (100.75 + 200) / 3, 1),
    ("breakeven_t2", "LONG", THIRDS, BE, 0, [(101.6, 99.9, 101.4), (101.5, 100.5, 100.6)], 2, "STOP", (100.75 + 101.5 + 100.75) / 3, 2),
    ("none_keeps", "LONG", THIRDS, NO, 0, [(100.8, 99.9, 100.6), (100.7, 99.5, 99.6)], 2, "END", (100.75 + 2 * 99.6) / 3, 1),
    ("lagged_t1", "LONG", THIRDS, LAG, 0, [(100.8, 99.9, 100.6), (100.7, 99.5, 99.6)], 2, "END", (100.75 + 2 * 99.6) / 3, 1),
    ("lagged_t2", "LONG", THIRDS, LAG, 0, [(101.6, 99.9, 101.4), (101.5, 99.8, 99.9)], 2, "STOP", (100.75 + 101.5 + 100) / 3, 2),
    ("not_within_bar", "LONG", THIRDS, BE, 0, [(100.8, 99.5, 100.2), (100.4, 100.1, 100.3)], 2, "END", (100.75 + 2 * 100.3) / 3, 1),
]


def _events(spark, rows):
    return spark.createDataFrame(
        rows,
        "epic string, direction string, entry_idx long, entry_price double, entry_atr double, stop_dist double, "
        "ladder array<struct<fraction: double, dist: double>>, ratchet string, max_holding_bars int",
    )


@pytest.fixture(scope="module")
def golden(spark):
    bars, events = [], []
    for name, side, ladder, ratchet, limit, after, *_ in GOLDEN:
        bars.append(bar(name, 0, 100, 100, 100))
        bars += [bar(name, i + 1, *b) for i, b in enumerate(after)]
        events.append((name, side, 0, 100.0, 1.0, 3.0, ladder, ratchet, limit))
    index = X.touch_index(spark.createDataFrame(bars, BAR_SCHEMA))
    out = X.pnl_columns(X.ladder_outcomes(_events(spark, events), index, 3))
    return {row["epic"]: row for row in out.collect()}


@pytest.mark.parametrize("case", GOLDEN, ids=[c[0] for c in GOLDEN])
def test_golden_outcome(golden, case):
    name, side, ladder, *_, idx, reason, price, tiers = case
    row = golden[name]
    assert (row["exit_idx"], row["exit_reason"], row["tiers_filled"]) == (idx, reason, tiers)
    assert row["exit_price"] == pytest.approx(price, abs=1e-9)
    assert row["hit_t1"] == (tiers >= 1)
    assert sum(f["fraction"] for f in row["fills"]) == pytest.approx(1.0)
    sign = 1 if side == "LONG" else -1
    assert row["pnl"] == pytest.approx(sign * (price - 100))
    assert row["r_multiple"] == pytest.approx(row["pnl"] / 3)


def test_fills_of_two_tiers_on_one_bar(golden):
    assert [f["price"] for f in golden["two_in_a_bar"]["fills"]] == [100.75, 101.5, 101.8]


def test_empty_ladder_is_an_error(spark):
    with pytest.raises(ValueError):
        X.ladder_outcomes(None, None, 0)


def test_zero_risk_has_zero_r(spark):
    rows = [("a", "LONG", 0, 100.0, 0.0, 0.0, SINGLE, NO, 0)]
    work = _events(spark, rows).withColumn("exit_price", F.lit(101.0))
    row = X.pnl_columns(work).first()
    assert (row["pnl"], row["r_multiple"], row["is_win"]) == (1.0, 0.0, True)


def test_entry_on_the_last_bar_ends_there(spark):
    bars = spark.createDataFrame([bar("a", 0, 1, 1, 1), bar("a", 1, 5, 4, 5)], BAR_SCHEMA)
    rows = [("a", "LONG", 1, 5.0, 1.0, 1.0, SINGLE, NO, 0)]
    row = X.ladder_outcomes(_events(spark, rows), X.touch_index(bars), 1).first()
    assert (row["exit_idx"], row["exit_reason"], row["exit_price"]) == (1, "END", 5.0)


@pytest.mark.parametrize("n", [300, 11])
def test_search_climbs_and_descends(spark, monkeypatch, n):
    """Blocks of 4: a series of 300 bars needs every level; of 11 bars, two suffice."""
    monkeypatch.setattr(X, "BLOCK", 4)
    rows = random_bars(n, "A", 3) + random_bars(n // 2, "B", 4)
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    rng = random.Random(5)
    events, expected = [], {}
    for i, (epic, idx, _, _, _, _, close, _) in enumerate(rows):
        lo, hi = close - rng.uniform(0, 25), close + rng.uniform(0, 25)
        events.append((i, epic, idx, lo, hi))
        later = [r for r in rows if r[0] == epic and r[1] > idx and (r[5] <= lo or r[4] >= hi)]
        expected[i] = min((r[1] for r in later), default=None)
    ev = spark.createDataFrame(events, "id int, epic string, idx long, lo double, hi double")
    out = X.first_touch(ev, X.touch_index(bars), "idx", "lo", "hi").collect()
    assert {r["id"]: r["touch"]["at"] if r["touch"] else None for r in out} == expected


def test_nan_levels_are_never_reached(spark):
    bars = spark.createDataFrame(random_bars(20), BAR_SCHEMA)
    ev = bars.where("idx = 0").withColumn("nan", F.lit(float("nan")))
    row = X.first_touch(ev, X.touch_index(bars), "idx", "nan", "nan").first()
    assert row["touch"] is None


def _greedy(events):
    free, kept = -1, []
    for s, f in sorted(events):
        if s >= free:
            kept.append(s)
            free = 10**18 if f is None else f
    return kept


@pytest.mark.parametrize("chunk", [512, 7])
def test_non_overlapping_selection(spark, monkeypatch, chunk):
    """Chunks of many and of few positions; holds that are shorter and longer than a chunk."""
    monkeypatch.setattr(X, "CHUNK", chunk)
    rng = random.Random(7)
    rows = []
    for key in range(6):
        for s in rng.sample(range(12_000), 150):
            hold = rng.choice([1, 5, 400]) if key < 5 else 2_000
            rows.append((key, s, None if rng.random() < 0.005 and key == 0 else s + hold))
    ev = spark.createDataFrame(rows, "k int, s long, f long")
    out = X.select_non_overlapping(ev, ["k"], "s", "f").collect()
    for key in range(6):
        assert sorted(r["s"] for r in out if r["k"] == key) == _greedy([r[1:] for r in rows if r[0] == key])
    tied = spark.createDataFrame([(1, 1, 9), (1, 1, 5), (1, 1, 5), (1, 5, 6), (1, 7, 8)], "k int, s long, f long")
    kept = X.select_non_overlapping(tied, ["k"], "s", "f").collect()
    assert sorted((r["s"], r["f"]) for r in kept) == [(1, 5), (5, 6), (7, 8)]


def test_selection_in_one_cluster_of_a_million_events(spark):
    """Every event blocks the next thousand, so no event is free whatever came before."""
    ev = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("s"), (F.col("id") + 1000).alias("f"))
    kept = [r.s for r in X.select_non_overlapping(ev, ["k"], "s", "f").select("s").collect()]
    assert sorted(kept) == list(range(0, 1_000_000, 1000))


def test_jump_table_equals_a_walk():
    rng = random.Random(4)
    for _ in range(200):
        s = sorted(rng.sample(range(60), rng.randint(1, 20)))
        f = [x + rng.choice([-3, 0, 1, 4, 30, 200]) for x in s]
        enter, leave = X.jump_table(np.array(s), np.array(f))
        for x in range(-2, 70):
            free = x
            for a, b in zip(s, f):
                if a >= free:
                    free = b
            step = int(np.searchsorted(enter, x))
            assert (leave[step] if step < len(enter) else x) == free
