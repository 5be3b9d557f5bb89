"""Buckets by selection, and grids of arms as rows."""

import random

import pytest
from pyspark.sql import functions as F

from barworks.operators import slices
from barworks.operators import votes as V
from barworks.operators.indicators import indicator_frame, needs_of
from barworks.plans import arms as A
from barworks.plans.ranking import promotion_gate
from barworks.plans.sweep import entries, sweep_bars
from barworks.session import materialize
from tests.helpers import BAR_SCHEMA, random_bars


def buckets_by_force(rows, k):
    out = {}
    for run in {r[0] for r in rows}:
        some = sorted((r[2], r[1], r[3], r[4]) for r in rows if r[0] == run and r[2] is not None and r[2] == r[2])
        per = max(1, len(some) // k)
        for b in range(0, len(some), per):
            part = some[b : b + per]
            out[run, b // per] = (part[0][0], part[-1][0], len(part), sum(x[2] for x in part), round(sum(x[3] for x in part), 6))
    return out


@pytest.mark.parametrize("held,cells", [(1 << 16, 1024), (3, 4)])
@pytest.mark.parametrize("text_tie", [True, False])
def test_buckets_equal_a_sort(spark, monkeypatch, held, cells, text_tie):
    """Few and many values, one dominant value, wide ranges, ties by number and by text."""
    monkeypatch.setattr(slices, "SORTED_ROWS", held)
    monkeypatch.setattr(slices, "CELLS", cells)
    rng = random.Random(5)
    kinds = {
        "dominant": lambda i: 7.25 if i % 3 else rng.uniform(-1, 20),
        "few": lambda i: float(i % 4),
        "wide": lambda i: (-1) ** i * 10.0 ** rng.uniform(-12, 12),
        "gaps": lambda i: [None, float("nan"), 0.0, -0.0, float("inf"), -5.0][i % 6],
        "one": lambda i: 3.0,
    }
    rows = []
    for run, make in kinds.items():
        for i in range({"few": 9, "one": 3}.get(run, 150)):
            tie = f"US500|2026-01-01T{i % 24:02d}:{i:04d}é" if text_tie else i * 10**15 + 3
            rows.append((run, tie, make(i), i % 3 == 0, float(i % 7) - 2))
    kind = "string" if text_tie else "long"
    table = spark.createDataFrame(rows, f"run_id string, tie {kind}, v double, is_win boolean, net_pnl double")
    some = table.where("v IS NOT NULL AND NOT isnan(v)")
    for k in (1, 4, 5):
        got = slices.slice_rows(some, ["run_id"], k, "tie").collect()
        mine = {(r.run_id, r.bucket): (r.lo, r.hi, r.trades, round(r.win_share * r.trades), round(r.net_avg_pnl * r.trades, 6)) for r in got}
        assert mine == buckets_by_force(rows, k)
    assert slices.slice_rows(some.where("false"), ["run_id"], 5, "tie").count() == 0


def test_every_stored_feature_can_be_sliced(spark):
    row = {name: 1.0 for name in slices.SLICE_FEATURES} | {"run_id": "r", "signal_key": "k", "is_win": True, "net_pnl": 2.0}
    out = slices.slice_all(spark.createDataFrame([row])).collect()
    assert sorted(r.feature for r in out) == sorted(slices.SLICE_FEATURES) and len(out) == 14


def grid(n):
    """Arms that differ in thresholds, multiples, votes and exits."""
    base = A.Arm(rsi_oversold=45.0, rsi_overbought=55.0, bb_multiplier=1.0, ema_period=9, trend_ema_period=21, enable_short=True)
    return [
        A.variant(
            base, f"arm{i}", confluence_threshold=1 + i % 3, rsi_oversold=30.0 + i % 17, bb_multiplier=0.5 + (i % 5) / 4,
            enable_structure=i % 2 == 0, trend_ema_max_atr=(i % 4) / 2, proximity_atr=0.25 * (1 + i % 3), stop_atr=1.0 + i % 7 / 4,
            max_holding_bars=i % 3 * 10, enable_short=i % 5 > 0,
        )
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def bars(spark):
    return materialize(spark.createDataFrame(random_bars(160, "A", 8) + random_bars(130, "B", 9), BAR_SCHEMA))


def by_force(frame, arms):
    """One projection per arm and direction, from the SQL text of its votes and gates."""
    found = set()
    for i in sorted(set(A.first_of_config(arms))):
        arm = arms[i]
        for is_long in (True, False):
            if arm.enable_long if is_long else arm.enable_short:
                votes = V.votes_of(arm, is_long)
                fire = f"idx >= {arm.warm_up} AND ({V.trend_gate(arm, is_long)}) AND ({V.score(votes)}) >= {arm.confluence_threshold}"
                names = "array_compact(array(" + ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql in votes) + "))"
                for r in frame.where("next_end_ts IS NOT NULL").where(fire).selectExpr("epic", "idx", f"{names} AS why").collect():
                    found.add((i, "LONG" if is_long else "SHORT", r.epic, r.idx, tuple(r.why)))
    return found


@pytest.mark.parametrize("chunk,word", [(64, 63), (3, 5)])
def test_signals_of_many_arms_equal_one_by_one(spark, bars, monkeypatch, chunk, word):
    monkeypatch.setattr(V, "CHUNK", chunk)
    monkeypatch.setattr(V, "WORD", word)
    arms = grid(24)
    frame = materialize(indicator_frame(bars, needs_of(arms)))
    got = V.signals(frame, arms).collect()
    mine = {(r.entry_id, r.direction, r.epic, r.signal_idx, tuple(r.reasons)) for r in got}
    assert len(got) == len(mine) > 100 and mine == by_force(frame, arms)
    assert all(r.features.confluence_score == len(r.reasons) for r in got)


def test_plan_does_not_grow_with_the_arms(spark, bars):
    """200 and 2,000 arms are one job each, and their plans have as many nodes."""
    nodes = []
    for n in (19, 200, 2000):
        arms = grid(n)
        found = entries(indicator_frame(bars, needs_of(arms, bands=False)), arms, gate_exit="none")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
        nodes.append(plan.count("+- ") + plan.count(":- "))
        assert found.select("entry_id").distinct().count() > n / 4
    assert len(set(nodes)) == 1


def test_equal_votes_count_twice(spark, bars):
    arm = A.Arm(confluence_threshold=2, enable_candles=False, enable_support_resistance=False, enable_volume_trend=False, trend_ema_period=0, ema_period=3)
    up = [("one", lambda a, is_long: "c > o"), ("two", lambda a, is_long: "c > o")]
    frame = materialize(indicator_frame(bars, needs_of([arm])))
    got = V.signals(frame, [arm], extra=up).collect()
    assert len(got) == frame.where("idx >= 3 AND c > o AND next_end_ts IS NOT NULL").count()
    assert all(tuple(r.reasons)[-2:] == ("one", "two") for r in got)


def test_sweep_of_one_and_of_many_arms(spark, bars):
    arms = grid(19)
    whole = {r.label: r for r in sweep_bars(bars, arms, F.lit(0.01)).metrics.collect()}
    assert len(whole) == 19
    for i in (0, 7, 18):
        (one,) = sweep_bars(bars, [arms[i]], F.lit(0.01)).metrics.collect()
        assert one.trades == whole[one.label].trades and one.total_net == pytest.approx(whole[one.label].total_net)


def test_milestones_pin_their_values_over_any_base():
    odd = A.Arm(
        confluence_threshold=2, enable_structure=True, enable_short=True, enable_long=False, trend_ema_period=100, proximity_atr=9.0,
        swing_lookback_bars=3, stop_atr=7.0, target_atr=7.0, ema_period=33,
    )
    arms = {a.name: a for a in A.reference_grid(odd)}
    final = arms["final_longOnly_trend200"]
    assert (final.confluence_threshold, final.enable_structure, final.enable_long, final.enable_short, final.trend_ema_period) == (3, False, True, False, 200)
    assert (final.proximity_atr, final.swing_lookback_bars, final.stop_atr, final.target_atr, final.ema_period) == (0.5, 10, 3.0, 0.75, 33)
    champion = arms["i3_pregate_winchamp_stop4.0_tgt0.5"]
    assert (champion.enable_long, champion.enable_short, champion.trend_ema_period, champion.swing_lookback_bars) == (True, True, 0, 8)
    first = arms["i1_baseline_th2_struct"]
    assert (first.enable_long, first.enable_short, first.trend_ema_period, first.proximity_atr) == (False, True, 0, 9.0)
    assert arms["control_singleTarget_0.75"].trend_ema_max_atr == 3.0 and arms["emaCeil_1.5atr"].stop_atr == 3.0
    assert A.reference_grid() == A.reference_grid(A.Arm())


def test_promotion_gate_without_a_control_passes_nothing(spark):
    rows = [(label, w, 50, 1.0, 5.0, 50.0, 4) for label in "ab" for w in ("IS", "OOS")]
    table = spark.createDataFrame(rows, "label string, window string, trades long, net_avg_pnl double, max_drawdown double, total_net double, positive_quarters long")
    assert promotion_gate(table, "none").count() == 0
    assert promotion_gate(table.withColumn("net_avg_pnl", F.when(F.col("label") == "b", 2.0).otherwise(1.0)), "a").first().label == "b"
