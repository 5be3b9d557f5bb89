"""Golden statistics and slices."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barworks.operators import slices, stats
from barworks.operators.ordered import number_by_value, number_rows
from barworks.plans import ranking

PNL = [2.5, 3.5, -0.5, -2.5, 6.5, -1.5]
DAYS = [(1, 10), (2, 10), (4, 10), (5, 10), (7, 10), (8, 10)]


def trades(spark, rows):
    data = [
        ("r", dt.datetime(y, m, d, tzinfo=dt.timezone.utc), f"k{i}", p, "LONG" if i % 2 else "SHORT")
        for i, (y, m, d, p) in enumerate(rows)
    ]
    schema = "run_id string, entry_ts timestamp, signal_key string, pnl double, direction string"
    return stats.with_net(spark.createDataFrame(data, schema), 0.5)


@pytest.mark.parametrize("turn", [1, -1])
def test_golden_statistics(spark, turn):
    t = trades(spark, [(2025, m, d, p) for (m, d), p in zip(DAYS, PNL)][::turn])
    row = stats.run_metrics(t, ["run_id"], ["entry_ts", "direction", "signal_key"]).first()
    assert row["max_drawdown"] == pytest.approx(4.0)
    assert (row["positive_quarters"], row["quarters"]) == (2, 3)
    assert row["worst_quarter_net_sum"] == pytest.approx(-4.0)
    assert row["worst_quarter_net_mean"] == pytest.approx(-2.0)
    assert row["return_over_drawdown"] == pytest.approx(5.0 / 4.0)
    by_q = {r["quarter"]: r["net"] for r in stats.net_by_quarter(t, ["run_id"]).collect()}
    assert by_q == pytest.approx({"2025Q1": 5.0, "2025Q2": -4.0, "2025Q3": 4.0})


def test_same_quarter_of_two_years_is_two_buckets(spark):
    t = trades(spark, [(2024, 11, 1, 1.0), (2025, 11, 1, 2.0)])
    assert stats.net_by_quarter(t, ["run_id"]).count() == 2


def test_drawdown_counts_from_zero_and_may_be_zero(spark):
    down = trades(spark, [(2025, 1, 1, -1.5), (2025, 1, 1, -0.5)])
    order = ["entry_ts", "signal_key"]
    assert stats.max_drawdown(down, ["run_id"], order).first()["max_drawdown"] == pytest.approx(3.0)
    up = trades(spark, [(2025, 1, 1, 1.5), (2025, 1, 2, 2.5)])
    row = stats.run_metrics(up, ["run_id"], order).first()
    assert row["max_drawdown"] == 0 and row["return_over_drawdown"] != row["return_over_drawdown"]


def test_empty_runs_are_zero(spark):
    t = trades(spark, [(2025, 1, 1, 1.0)]).where("pnl > 5")
    runs = spark.createDataFrame([("r",)], "run_id string")
    row = stats.run_metrics(t, ["run_id"], ["entry_ts", "signal_key"], 10, runs).first()
    assert row["trades"] == 0 and row["net_avg_pnl"] == 0 and row["max_drawdown"] == 0
    assert row["trades_per_day"] == 0


def sliced(spark, rows, k, feature="atr_value"):
    t = spark.createDataFrame(
        [("r", f"k{i:05d}", float(v), w, float(n)) for i, (v, w, n) in enumerate(rows)],
        f"run_id string, signal_key string, {feature} double, is_win boolean, net_pnl double",
    )
    return slices.slice_feature(t, feature, k).orderBy("bucket").collect()


def test_two_groups_slice_into_two_buckets(spark):
    rows = [(0.5, True, 1)] * 4 + [(5.0, False, -2)] * 4
    out = sliced(spark, rows, 2)
    assert [(r["trades"], r["win_share"], r["net_avg_pnl"]) for r in out] == [(4, 1.0, 1.0), (4, 0.0, -2.0)]
    assert all(r["baseline_win"] == 0.5 for r in out)
    assert [r["drag"] for r in out] == [False, True]


def test_remainder_is_an_extra_bucket(spark):
    out = sliced(spark, [(i, True, 0) for i in range(102)], 4)
    assert [r["trades"] for r in out] == [25, 25, 25, 25, 2]
    assert out[-1]["confidence"] == pytest.approx(0.3)


def test_unknown_features_are_refused(spark):
    with pytest.raises(ValueError):
        slices.check_feature("pnl; drop table")
    assert (slices.checked_buckets(1), slices.checked_buckets(20)) == (1, 20)
    with pytest.raises(ValueError):
        slices.checked_buckets(0)


def test_positions_by_value_with_one_dominant_value(spark):
    """A third of the rows share one value and are spread over many parts."""
    rows = [(1, i, 7.0 if i % 3 == 0 else ((i * 7919) % 1000 - 500) / 3.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t long, v double")
    out = number_by_value(df, ["k"], "v", "t", F.floor(F.col("t") / 50)).toPandas()
    want = pd.DataFrame(rows, columns=["k", "t", "v"]).sort_values(["v", "t"]).reset_index(drop=True)
    assert out.sort_values("pos").t.tolist() == want.t.tolist()
    assert sorted(out.pos) == list(range(3000)) and set(out.n) == {3000}


def test_positions_in_chunks(spark):
    rows = [("a", (i * 37) % 500) for i in range(500)] + [("b", 3)]
    df = spark.createDataFrame(rows, "k string, t long")
    out = number_rows(df, ["k"], ["t"], [F.floor(F.col("t") / 64)]).collect()
    assert all(r["idx"] == (r["t"] if r["k"] == "a" else 0) for r in out)


def test_repair_is_idempotent_and_guarded(spark):
    t = trades(spark, [(2025, 1, 1, 1.0), (2025, 1, 2, 3.0)]).withColumn("net_pnl", F.col("pnl"))
    runs = spark.createDataFrame([("r", 1.5)], "run_id string, net_avg_pnl double")
    once = stats.repair_net(t, runs)
    twice = stats.repair_net(once, runs)
    assert sorted(r["net_pnl"] for r in twice.collect()) == pytest.approx([0.5, 2.5])
    other = runs.withColumn("run_id", F.lit("gone"))
    assert sorted(r["net_pnl"] for r in stats.repair_net(once, other).collect()) == pytest.approx([0.5, 2.5])


def gate_rows(spark, *rows):
    schema = (
        "label string, window string, trades long, net_avg_pnl double, max_drawdown double, "
        "total_net double, positive_quarters long"
    )
    return spark.createDataFrame(list(rows), schema)


def test_promotion_gate(spark):
    m = gate_rows(
        spark,
        ("control", "OOS", 40, 0.5, 10.0, 20.0, 2), ("control", "IS", 90, 0.5, 10.0, 20.0, 3),
        ("good", "OOS", 30, 0.9, 10.0, 27.0, 2), ("good", "IS", 90, 0.5, 10.0, 20.0, 3),
        ("best", "OOS", 50, 0.8, 5.0, 40.0, 2), ("best", "IS", 90, 0.5, 10.0, 20.0, 4),
        ("few", "OOS", 29, 0.9, 9.0, 27.0, 2), ("few", "IS", 90, 0.5, 10.0, 20.0, 4),
        ("deep", "OOS", 40, 0.9, 10.1, 27.0, 2), ("deep", "IS", 90, 0.5, 10.0, 20.0, 4),
        ("unsteady", "OOS", 40, 0.9, 9.0, 27.0, 4), ("unsteady", "IS", 90, 0.5, 10.0, 20.0, 2),
    )
    out = ranking.promotion_gate(m, "control").orderBy("place").collect()
    assert [r["label"] for r in out] == ["best", "good"]


def test_no_arm_passing_is_valid(spark):
    m = gate_rows(spark, ("control", "OOS", 40, 0.5, 10.0, 20.0, 2), ("a", "OOS", 40, 0.4, 1.0, 1.0, 4))
    assert ranking.promotion_gate(m, "control").count() == 0
