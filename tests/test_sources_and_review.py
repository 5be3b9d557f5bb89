"""Sources, run tables, arms, annotations and vocabularies."""

import datetime as dt
import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from barworks.functions.guards import above, at_most, below, ratio
from barworks.functions.instants import iso_instant
from barworks.operators import bars as B
from barworks.operators import review as V
from barworks.operators.features import bracket, signal_key
from barworks.operators.indicators import indicator_frame, needs_of
from barworks.operators.ordered import join_per_key
from barworks.plans.arms import Arm, Tier, arms_frame, check_arms, check_ladder, reference_grid, variant
from barworks.plans.ranking import promotion_gate
from barworks.plans.sweep import entries, sweep_bars, sweep_quotes, sweep_windows
from barworks.schemas import MARK_KINDS, QUOTE, require
from barworks.session import materialize
from barworks.sources import quotes as Q
from barworks.sources import runs as R
from tests.helpers import BAR_SCHEMA, random_bars

UTC = dt.timezone.utc


def at(*args):
    return dt.datetime(*args, tzinfo=UTC)


def quote(i, epic, ts, mid, volume=10):
    return (str(i), epic, "MINUTE", ts, *[mid - 0.5 if k % 2 == 0 else mid + 0.5 for k in range(8)], volume, "t", ts)


@pytest.fixture(scope="module")
def quotes(spark):
    rows = [quote(i, "A", at(2026, 1, 1, 0, i + 1), 100.0 + i) for i in range(12)]
    rows += [quote(99, "B", at(2026, 1, 2, 0, 1), 5.0)]
    return spark.createDataFrame(rows, QUOTE)


def test_bars_close_on_their_last_minute(quotes):
    """A bar stamped 00:05 ends the first five-minute bucket; the open third bucket is dropped."""
    out = B.resample(quotes, 5).where("epic = 'A'").orderBy("idx").collect()
    assert [(r["o"], r["h"], r["l"], r["c"], r["volume"]) for r in out] == [
        (100, 104, 100, 104, 50), (105, 109, 105, 109, 50)]
    assert out[0]["end_ts"].replace(tzinfo=UTC) == at(2026, 1, 1, 0, 5)
    assert B.resample(quotes, 5, keep_open_bucket=True).where("epic = 'A'").count() == 3
    assert B.resample(quotes, 5).where("epic = 'B'").count() == 0


def test_windows_are_half_open_by_default(quotes):
    lo, hi = at(2026, 1, 1, 0, 2), at(2026, 1, 1, 0, 4)
    assert Q.quotes_between(quotes, "A", lo, hi).count() == 2
    assert Q.quotes_between(quotes, "A", lo, hi, closed="both").count() == 3


def test_quote_table_round_trip(spark, quotes, tmp_path):
    path = str(tmp_path / "quotes")
    Q.write_quotes(quotes, path)
    back = Q.read_quotes(spark, path)
    assert back.count() == 13
    day = Q.quotes_between(back, "A", at(2026, 1, 1), at(2026, 1, 2))
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()
    assert Q.first_quotes(back, "A", 3).count() == 3
    spread = {r["epic"]: r["count"] for r in back.groupBy("epic").count().collect()}
    Q.write_quotes(quotes.where("epic = 'A'"), path)
    assert {r["epic"]: r["count"] for r in Q.read_quotes(spark, path).groupBy("epic").count().collect()} == spread
    with pytest.raises(ValueError):
        require(back.drop("close_bid"), QUOTE.fieldNames())


@pytest.mark.parametrize(
    "args", [(" ", "MINUTE"), ("A", None), ("A", "MINUTE", 2, 2), ("A", "MINUTE", 1, 2, 0)]
)
def test_bad_price_requests_are_refused(args):
    with pytest.raises(ValueError):
        Q.check_price_request(*args)


def test_price_replies_flatten_and_keep_the_latest(spark, tmp_path):
    def reply(bid):
        leg = {"bid": bid, "ask": bid + 1, "lastTraded": None}
        item = {"snapshotTimeUTC": "2026-01-01T00:01:00", "lastTradedVolume": 7}
        item |= {f"{n}Price": leg for n in ("open", "high", "low", "close")}
        return {"epic": "A", "resolution": "MINUTE", "prices": [item]}

    (tmp_path / "r.json").write_text("\n".join(json.dumps(reply(b)) for b in (10.25, 11.25)))
    replies = Q.read_price_replies(spark, str(tmp_path))
    stamped = F.when(F.col("prices")[0]["openPrice"]["bid"] > 11, F.lit(at(2026, 1, 3))).otherwise(F.lit(at(2026, 1, 2)))
    out = Q.flatten_price_replies(replies, stamped, "test").collect()
    assert len(out) == 1 and out[0]["close_bid"] == 11.25 and out[0]["close_ask"] == 12.25


def test_index_at_or_after_spans_days_without_bars(spark):
    rows = [("A", i, t) for i, t in enumerate([at(2026, 1, 1, 10), at(2026, 1, 1, 11), at(2026, 1, 5, 9)])]
    bars = spark.createDataFrame(rows, "epic string, idx long, end_ts timestamp")
    asked = [at(2025, 12, 1), at(2026, 1, 1, 11), at(2026, 1, 1, 12), at(2026, 1, 3), at(2026, 1, 5, 10), at(2027, 1, 1)]
    ev = spark.createDataFrame([("A", i, t) for i, t in enumerate(asked)], "epic string, id int, at timestamp")
    out = {r["id"]: r["bar_idx"] for r in B.index_at_or_after(ev, bars, "at").collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2}


@pytest.mark.parametrize("block", [256, 4])
def test_index_at_or_after_where_one_day_holds_most_bars(spark, monkeypatch, block):
    """Many bars a second on one day, gaps of days, equal ends, no instant, an unknown series."""
    monkeypatch.setattr(B, "BLOCK", block)
    start, rng = at(2026, 1, 1), random.Random(2)
    ends = sorted([start + dt.timedelta(seconds=rng.randrange(200)) for _ in range(900)] + [start + dt.timedelta(days=rng.randrange(40)) for _ in range(60)])
    bars = spark.createDataFrame([(e, i, t) for e in "AB" for i, t in enumerate(ends)], "epic string, idx long, end_ts timestamp")
    asked = [start + dt.timedelta(seconds=rng.randrange(-50, 300)) for _ in range(200)] + [start + dt.timedelta(days=rng.randrange(50)) for _ in range(50)]
    ev = spark.createDataFrame([("A", i, t) for i, t in enumerate([*asked, None])] + [("Z", 999, start)], "epic string, id int, at timestamp")
    out = {r["id"]: r["bar_idx"] for r in B.index_at_or_after(ev, bars, "at").collect()}
    want = {i: next((k for k, e in enumerate(ends) if e >= t), len(ends) - 1) for i, t in enumerate(asked)}
    assert out == {**want, len(asked): len(ends) - 1, 999: None}


def test_display_and_outcome_brackets(spark):
    row = spark.range(1).select(
        *bracket(F.lit("LONG"), F.lit(5000.0), F.lit(4.0), F.lit(3.0), F.lit(0.75)),
        *bracket(F.lit("SHORT"), F.lit(5000.0), F.lit(4.0), F.lit(3.0), F.lit(0.75)),
        signal_key(F.lit("A"), F.lit(at(2026, 1, 1, 15, 30)), F.lit("LONG")),
        iso_instant(F.lit(at(2026, 1, 1, 0, 0, 0, 250000))),
    ).first()
    assert tuple(row) == (4988.0, 5003.0, 5012.0, 4997.0, "A|2026-01-01T15:30:00Z|LONG", "2026-01-01T00:00:00.250Z")


def test_nan_passes_no_comparison(spark):
    nan = F.lit(float("nan"))
    row = spark.range(1).select(below(nan, F.lit(1.0)), above(nan, F.lit(1.0)), at_most(F.lit(1.0), nan), ratio(F.lit(1.0), F.lit(0.0))).first()
    assert tuple(row)[:3] == (False, False, False) and math.isnan(row[3])


@pytest.mark.parametrize(
    "tiers",
    [
        (Tier(0.5, 1.0),), (Tier(0.5, 1.0), Tier(0.6, 2.0)), (Tier(0.0, 1.0), Tier(1.0, 2.0)),
        (Tier(-0.5, 1.0), Tier(1.5, 2.0)), (Tier(0.5, 2.0), Tier(0.5, 1.0)), (Tier(0.5, 1.0), Tier(0.5, 1.0)),
        (Tier(math.nan, 1.0),), (Tier(1.0, math.nan),), (Tier(math.inf, 1.0),), (Tier(1.0, math.inf),),
    ],
)
def test_bad_ladders_are_refused(tiers):
    with pytest.raises(ValueError):
        check_ladder(Arm(tiers=tiers))


def test_ladders_are_not_renormalised_and_may_be_empty():
    check_ladder(Arm())
    arm = Arm(tiers=(Tier(0.3333333, 1.0), Tier(0.3333333, 2.0), Tier(0.3333333, 3.0)))
    check_ladder(arm)
    assert arm.tiers[0].fraction == 0.3333333


def test_grid(spark):
    grid = {a.name: a for a in reference_grid()}
    assert len(grid) == 19
    assert grid["control_singleTarget_0.75"].tiers == ()
    assert grid["tier3_t3-2.0_none"].tiers[2].target_atr == 2.0
    assert grid["tier3_t3-4.0_none"].tiers[2].target_atr == 4.0
    assert grid["tier3_t3-3.0_breakeven_after_t1"].ratchet == "BREAKEVEN_AFTER_T1"
    control = grid["control_singleTarget_0.75"].entry_config
    assert all(a.entry_config == control for n, a in grid.items() if n.startswith("tier3"))
    kept = variant(grid["tier3_t3-3.0_lagged"], "copy", stop_atr=2.5)
    assert kept.tiers == grid["tier3_t3-3.0_lagged"].tiers and kept.ratchet == "LAGGED"
    assert arms_frame(spark, list(grid.values())).count() == 19
    with pytest.raises(ValueError):
        check_arms([Arm(name="a"), Arm(name="a")])


def test_one_tier_ladder_equals_the_single_target(spark):
    base = Arm(name="single", ema_period=9, trend_ema_period=0, confluence_threshold=2, enable_short=True)
    arms = [base, variant(base, "ladder", tiers=(Tier(1.0, base.target_atr),), ratchet="LAGGED")]
    bars = spark.createDataFrame(random_bars(800, "A", 21) + random_bars(500, "B", 22), BAR_SCHEMA)
    result = sweep_bars(bars, arms, F.lit(0.1), segment=256)
    rows = {r["label"]: r.asDict() for r in result.metrics.collect()}
    assert rows["single"]["trades"] > 20
    a, b = ({k: v for k, v in rows[n].items() if k != "label"} for n in ("single", "ladder"))
    assert a == pytest.approx(b)
    per_epic = sweep_bars(bars, arms, F.lit(0.1), per_instrument=True).metrics
    assert {(r["label"], r["epic"]) for r in per_epic.collect()} == {(n, e) for n in ("single", "ladder") for e in "AB"}


def _moving_gate(frame, s):
    """Brute force: first later bar whose close is beyond its own ATR distances."""
    sign = 1 if s["direction"] == "LONG" else -1
    for b in frame:
        if b["epic"] == s["epic"] and b["idx"] > s["entry_idx"]:
            gone = sign * (b["c"] - s["entry_price"])
            if gone <= -s["stop_atr"] * b["atr_14"] or gone >= s["target_atr"] * b["atr_14"]:
                return b["idx"]
    return None


def test_gate_may_follow_the_current_atr(spark):
    arms = [
        Arm(name="a", ema_period=9, trend_ema_period=0, confluence_threshold=2, enable_short=True),
        Arm(name="b", ema_period=9, trend_ema_period=0, confluence_threshold=2, stop_atr=1.0, target_atr=2.0),
    ]
    bars = spark.createDataFrame(random_bars(900, "A", 41), BAR_SCHEMA)
    frame = materialize(indicator_frame(bars, needs_of(arms)))
    taken = entries(frame, arms, gate_exit="close_current_atr").collect()
    ordered = frame.select("epic", "idx", "c", "atr_14").orderBy("idx").collect()
    assert len(taken) > 20 and {s["direction"] for s in taken} == {"LONG", "SHORT"}
    assert [s["gate_idx"] for s in taken] == [_moving_gate(ordered, s) for s in taken]
    assert {s["entry_id"] for s in taken} == {0, 1}


def test_sweep_to_store_to_review(spark, tmp_path):
    """Quotes → windows → metrics; trades saved, loaded for review with their bars, and exported."""
    base = Arm(name="base", ema_period=9, trend_ema_period=0, confluence_threshold=2, enable_short=True)
    rows = [quote(i, "A", b[2], b[6]) for i, b in enumerate(random_bars(600, "A", 51))]
    quotes = spark.createDataFrame(rows, QUOTE)
    cut = at(2026, 1, 2)
    windows = {"IS": (at(2026, 1, 1), cut), "OOS": (cut, at(2026, 1, 4))}
    metrics = sweep_windows(quotes, 5, [base, variant(base, "wide", stop_atr=6.0)], windows)
    assert {(r["label"], r["window"]) for r in metrics.collect()} == {(n, w) for n in ("base", "wide") for w in windows}
    assert promotion_gate(metrics, "base").count() <= 1

    result = sweep_quotes(quotes, 5, [base])
    span = ("2026-01-01T00:00:00Z", "2026-01-04T00:00:00Z")
    exps = R.experiment_rows(result.metrics, result.arms, "A", 5, span, "v1")
    trades = join_per_key(result.trades, exps.select("label", "experiment_id"), ["label"])
    root = str(tmp_path)
    R.save_experiments(exps, trades, root)
    saved, kept = R.read_experiments(spark, root)
    assert saved.count() == 1 and kept.count() == result.trades.count() > 10
    runs = R.run_rows(saved, 2.0)
    assert tuple(runs.columns) == R.RUN_COLUMNS
    bars = B.resample(quotes, 5)
    review = R.review_trades(kept.withColumn("run_id", F.col("experiment_id")), bars)
    R.load_run(runs, review.drop("ladder", "fills"), f"{root}/review")
    loaded = R.read_runs(spark, f"{root}/review")[1]
    row = loaded.orderBy("entry_idx").first()
    assert len(row["bars"]) == min(row["exit_idx"] + 50, bars.count() - 1) - max(row["entry_idx"] - 50, 0) + 1
    out = R.export_rows(runs, loaded.select("run_id", "signal_key", "entry_ts", "is_win", "bars"))
    assert out.count() == kept.count()


def test_runs_load_idempotently(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.createDataFrame([("r1", "first"), ("r2", "second")], "id string, label string")
    trades = spark.createDataFrame([("r1", "k1", 1.0), ("r1", "k2", 2.0), ("r2", "k1", 3.0)], "run_id string, signal_key string, pnl double")
    R.load_run(runs, trades, root)
    R.load_run(runs.where("id = 'r1'"), trades.where("run_id = 'r1' AND signal_key = 'k2'"), root)
    loaded, back = R.read_runs(spark, root)
    assert sorted(r["id"] for r in back.collect()) == ["r1:k2", "r2:k1"] and loaded.count() == 2
    R.load_run(runs.where("id = 'r2'"), trades.where("false"), root)
    loaded, back = R.read_runs(spark, root)
    assert [r["id"] for r in back.collect()] == ["r1:k2"] and loaded.count() == 2


def test_rerun_without_trades_clears_the_old_ones(spark, tmp_path):
    root = str(tmp_path)
    t = spark.createDataFrame([(1, 1.0), (2, 2.0)], "experiment_id int, pnl double")
    both = t.select("experiment_id", F.lit("x").alias("label"))
    R.save_experiments(both, t, root)
    R.save_experiments(both.where("experiment_id = 1"), t.where("false"), root)
    experiments, trades = R.read_experiments(spark, root)
    assert experiments.count() == 2 and [r["experiment_id"] for r in trades.collect()] == [2]


def test_runs_that_share_a_signal_key_have_their_own_bars(spark):
    bars = spark.createDataFrame(random_bars(600, "A", 3), BAR_SCHEMA)
    rows = [("r1", "A", "k", 100, 110), ("r2", "A", "k", 100, 400)]
    trades = spark.createDataFrame(rows, "run_id string, epic string, signal_key string, entry_idx long, exit_idx long")
    out = {r["run_id"]: len(r["bars"]) for r in R.review_trades(trades, bars).collect()}
    assert out == {"r1": 111, "r2": 401}


def test_export_leaves_other_runs(spark, tmp_path):
    path = str(tmp_path / "json")
    runs = spark.createDataFrame([("r1",), ("r2",)], "id string")
    trades = spark.createDataFrame([("r1", "k1", True)], "run_id string, signal_key string, is_win boolean")
    R.export_runs(runs, trades, path)
    R.export_runs(runs.where("id = 'r1'"), trades, path)
    assert sorted(r["run_id"] for r in spark.read.json(path).collect()) == ["r1", "r2"]


def test_two_writers_of_one_run(spark, tmp_path):
    """Both write at once; whoever commits last is read whole, and the other can be cleaned."""
    root = str(tmp_path)
    runs = spark.createDataFrame([("r1", "x"), ("r2", "x")], "id string, label string")

    def save(label, pnl):
        own = spark.createDataFrame([("r1", f"k{i}", pnl) for i in range(5)], "run_id string, signal_key string, pnl double")
        R.load_run(runs.where("id = 'r1'").withColumn("label", F.lit(label)), own, root)

    R.load_run(runs, spark.createDataFrame([("r2", "k", 9.0)], "run_id string, signal_key string, pnl double"), root)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(save, ("a", "b"), (1.0, 2.0)))
    heads, trades = R.read_runs(spark, root)
    (won,) = [r.label for r in heads.where("id = 'r1'").collect()]
    assert [r.pnl for r in trades.where("run_id = 'r1'").collect()] == [{"a": 1.0, "b": 2.0}[won]] * 5
    assert trades.where("run_id = 'r2'").count() == 1
    assert R.clean_runs(spark, root) == []  # too young to tell from one that is under way
    assert len(R.clean_runs(spark, root, older_than_s=-60)) == 1
    heads, trades = R.read_runs(spark, root)
    assert heads.count() == 2 and trades.count() == 6


def test_many_arms_are_few_folders_and_a_lookup_reads_few_rows(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.range(2000).select(F.format_string("run%05d", "id").alias("id"), F.lit("x").alias("label"))
    trades = spark.range(60_000).select(
        F.format_string("run%05d", F.col("id") % 2000).alias("run_id"), F.format_string("k%07d", "id").alias("signal_key"), F.lit("A").alias("epic"),
        (F.col("id") % 300).alias("entry_idx"), (F.col("id") % 300 + 7).alias("exit_idx"),
    )
    R.load_run(runs, trades, root)
    assert len(list((tmp_path / "trades").iterdir())) == 1 and len(list((tmp_path / "trades").rglob("*.parquet"))) <= 8
    assert [r.label for r in R.read_run(spark, root, "run00777").collect()] == ["x"] and R.read_run(spark, root, "none").count() == 0

    bars = spark.createDataFrame(random_bars(400, "A", 3) + random_bars(50, "B", 3), BAR_SCHEMA)
    (row,) = R.read_trade(spark, root, "run00777:k0000777", bars).collect()
    assert row.entry_idx == 777 % 300 and len(row.bars) == 7 + 101
    assert R.read_trade(spark, root, "run00777:k0000778", bars).count() == 0

    one = spark.read.parquet(f"{root}/trades").where("id = 'run00777:k0000777'")
    one.collect()
    node = one._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    assert node.metrics().apply("numOutputRows").value() <= 20_000  # of 60,000: one of the files


def test_uncommitted_trades_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    t = spark.createDataFrame([(1, 1.0), (2, 2.0)], "experiment_id int, pnl double")
    first = t.where("experiment_id = 1").select("experiment_id", F.lit("one").alias("label"))
    R.save_experiments(first, t, root)
    experiments, trades = R.read_experiments(spark, root)
    assert experiments.count() == 1 and [r["experiment_id"] for r in trades.collect()] == [1]


def test_last_verdict_wins_and_reattaches(spark):
    log = spark.createDataFrame(
        [("k", "chop", None, at(2026, 1, 1), 1), ("k", "bad-exit", "late", at(2026, 1, 2), 2)],
        "signal_key string, flag string, note string, created_at timestamp, id int",
    )
    rerun = spark.createDataFrame([("run2", "k"), ("run2", "z")], "run_id string, signal_key string")
    out = {r["signal_key"]: r["flag"] for r in V.attach(rerun, V.latest_feedback(log)).collect()}
    assert out == {"k": "bad-exit", "z": None}
    assert [r["signal_key"] for r in V.unreviewed(rerun, log).collect()] == ["z"]


def test_marks_move_and_are_deleted_by_kind(spark):
    log = spark.createDataFrame(
        [
            ("k", "T1", at(2026, 1, 1, 15), at(2026, 1, 2), 1, False),
            ("k", "T1", at(2026, 1, 1, 15, 30), at(2026, 1, 3), 2, False),
            ("k", "T2", at(2026, 1, 1, 16), at(2026, 1, 3), 3, False),
            ("k", "T2", at(2026, 1, 1, 16), at(2026, 1, 4), 4, True),
        ],
        "signal_key string, kind string, bar_ts timestamp, created_at timestamp, id int, deleted boolean",
    )
    out = V.latest_marks(log).collect()
    assert [(r["kind"], r["bar_ts"].replace(tzinfo=UTC)) for r in out] == [("T1", at(2026, 1, 1, 15, 30))]


def test_vocabularies_and_completeness(spark):
    rows = spark.createDataFrame([("chop",), (None,), ("bogus",)], "flag string")
    good, bad = V.split_vocabulary(rows, V.known_flag(F.col("flag")))
    assert good.count() == 2 and [r["flag"] for r in bad.collect()] == ["bogus"]
    kinds = spark.createDataFrame([(k,) for k in (*MARK_KINDS, "T9", None)], "kind string")
    assert kinds.where(V.known_kind(F.col("kind"))).count() == 5
    t = spark.createDataFrame([(1, 2.0), (2, None)], "id int, pnl double")
    good, bad = V.split_complete(t, ("id", "pnl"))
    assert good.count() == 1 and bad.first()["missing_fields"] == ["pnl"]


def test_visible_and_price_range(spark):
    t = spark.createDataFrame([("r", at(2026, 1, 1), at(2026, 1, 1, 0, 10))], "run string, entry_ts timestamp, exit_ts timestamp")
    row = B.visible_range(t, ["run"]).first()
    start = int(at(2026, 1, 1).timestamp())
    assert (row["visible_from"], row["visible_to"]) == (start - 1800, start + 600 + 1800)
    bars = F.array(F.struct(F.lit(1.0).alias("l"), F.lit(3.0).alias("h")))
    cols = B.price_range(bars, [F.lit(5.0)])
    assert tuple(spark.range(1).select(*cols.values()).first()) == pytest.approx((0.92, 5.08))
    flat = F.array(F.struct(F.lit(2.0).alias("l"), F.lit(2.0).alias("h")))
    assert tuple(spark.range(1).select(*B.price_range(flat).values()).first()) == (1.0, 3.0)
