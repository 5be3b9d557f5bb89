"""Streams against their batch counterparts, over several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barworks.operators.indicators import indicator_frame, needs_of
from barworks.plans.arms import Arm
from barworks.streaming import ticks as S
from barworks.streaming.live_indicators import late_bars, live_indicators, on_time, smoothed
from tests.helpers import BAR_SCHEMA, random_bars

UTC = dt.timezone.utc


def test_blank_subscriptions_are_refused():
    for epics, resolutions in (((), ("M",)), (("A", " "), ("M",)), (("A",), ())):
        with pytest.raises(ValueError):
            S.Subscription(epics, resolutions)


def test_live_indicators_equal_the_batch_scan(spark, tmp_path):
    arm = Arm(ema_period=9, trend_ema_period=0)
    rows = random_bars(120, "A", 31) + random_bars(90, "B", 32)
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    source = str(tmp_path / "bars")
    for part in range(3):  # one file per micro-batch, in time order
        bars.where(F.floor(F.col("idx") / 40) == part).withColumn("tie", F.col("idx")).coalesce(1).write.mode(
            "append"
        ).parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    live = live_indicators(stream, 9, arm.rsi_period, arm.atr_period)
    run = S.to_table(live, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    run.awaitTermination()
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == 3
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["epic", "tie"])
    want = indicator_frame(bars, needs_of([arm])).toPandas().sort_values(["epic", "idx"])
    for a, b in (("ema", "ema_9"), ("rsi", "rsi_7"), ("atr", "atr_14")):
        assert got[a].tolist() == pytest.approx(want[b].tolist(), abs=1e-9)


def test_late_ticks_are_dropped_and_bars_come_out_once(spark, tmp_path):
    def tick(i, hh, mm, price):
        return (f"t{i}", "A", price - 0.5, price + 0.5, dt.datetime(2026, 1, 1, hh, mm, tzinfo=UTC))

    schema = "correlation_id string, epic string, bid double, ofr double, ts timestamp"
    batches = [
        [tick(1, 0, 1, 10.0), tick(2, 0, 3, 12.0)],
        [tick(3, 0, 31, 20.0)],
        [tick(6, 0, 32, 20.0)],  # late rows are judged by the watermark of the batch before
        [tick(4, 0, 2, 99.0), tick(5, 1, 30, 21.0)],  # the first is behind the watermark
    ]
    source = str(tmp_path / "ticks")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = S.to_table(S.tick_bars(stream, "5 minutes", "5 minutes"), str(tmp_path / "o"), str(tmp_path / "c"), once=True)
    run.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "o")).orderBy("begin_ts").collect()
    assert [(r["o"], r["h"], r["l"], r["c"], r["volume"]) for r in out] == [(10, 12, 10, 12, 2), (20, 20, 20, 20, 2)]


def test_landing_replaces_its_own_batch(spark, tmp_path):
    schema = "id int, ts timestamp"
    rows = [(1, dt.datetime(2026, 1, 1, tzinfo=UTC)), (1, dt.datetime(2026, 1, 1, tzinfo=UTC)), (2, dt.datetime(2026, 1, 2, tzinfo=UTC))]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    for attempt in range(2):  # a fresh checkpoint replays batch 0 over the landed one
        stream = S.unique_rows(spark.readStream.schema(schema).parquet(source), "id", "ts", "1 hour")
        S.land(stream, out, str(tmp_path / f"cp{attempt}"), "ts", once=True).awaitTermination()
    back = spark.read.parquet(out)
    assert sorted(r["id"] for r in back.collect()) == [1, 2]
    assert "date" in back.columns and "batch_id" in back.columns


def feed(spark, tmp_path, batches, schema, transform, write=S.to_table):
    """One file per micro-batch, run to the end; the rows that came out."""
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    write(transform(stream), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("most_held", [10_000, 12])
def test_disordered_bars_equal_the_batch_scan(spark, tmp_path, monkeypatch, most_held):
    """Bars come up to 30 minutes late and out of order; one comes two hours late."""
    monkeypatch.setattr("barworks.streaming.live_indicators.MOST_HELD", most_held)
    arm = Arm(ema_period=9, trend_ema_period=0)
    rows = random_bars(120, "A", 41) + random_bars(70, "B", 42)
    lost = ("A", 30)
    kept = [r for r in rows if (r[0], r[1]) != lost]
    late = [r for r in rows if (r[0], r[1]) == lost]
    shuffled = [kept[i : i + 6][::-1] for i in range(0, len(kept), 6)]  # six bars of five minutes
    order = [r for part in shuffled for r in part]
    far = dt.datetime(2026, 1, 9, tzinfo=UTC)  # moves the watermark past every bar
    batches = [order[:60], order[60:100] + late, order[100:], [("Z", 0, far, 1.0, 1.0, 1.0, 1.0, 1.0)], [("Z", 1, far + dt.timedelta(days=1), 1.0, 1.0, 1.0, 1.0, 1.0)]]
    out = feed(
        spark, tmp_path, batches, BAR_SCHEMA,
        lambda s: live_indicators(s.withColumn("tie", F.col("idx")), 9, arm.rsi_period, arm.atr_period, hold="30 minutes", quiet="2 days"),
    )
    assert [(r.epic, r.tie) for r in late_bars(out).collect()] == [lost]
    got = on_time(out).where("epic <> 'Z'").toPandas().sort_values(["epic", "tie"])
    again = [(e, i, *rest) for e in "AB" for i, (_, _, *rest) in enumerate(sorted((r for r in kept if r[0] == e), key=lambda r: r[1]))]
    want = indicator_frame(spark.createDataFrame(again, BAR_SCHEMA), needs_of([arm])).toPandas().sort_values(["epic", "idx"])
    for a, b in (("ema", "ema_9"), ("rsi", "rsi_7"), ("atr", "atr_14")):
        assert got[a].tolist() == pytest.approx(want[b].tolist(), abs=1e-9)


def test_smoothed_equals_the_recurrence():
    import numpy as np

    values = np.random.default_rng(1).normal(size=3000)
    for alpha in (1.0, 2 / 3, 0.5, 0.01):
        last, want = 3.0, []
        for x in values:
            last += alpha * (x - last)
            want.append(last)
        assert np.allclose(smoothed(values, alpha, 3.0), want, rtol=1e-9, atol=1e-12)


def test_two_checkpoints_land_every_row_once(spark, tmp_path):
    """The second stream begins at batch 0 again, reads the old rows once more and some new ones."""
    schema = "id int, ts timestamp"
    at = [dt.datetime(2026, 1, d, tzinfo=UTC) for d in (1, 1, 2, 3, 3)]
    rows = list(enumerate(at))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        S.land(stream, out, str(tmp_path / checkpoint), "ts", once=True, key=["id"]).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    spark.createDataFrame(rows[:2], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame(rows[2:3], schema).coalesce(1).write.mode("append").parquet(source)
    assert run("a") == [0, 1, 2]
    spark.createDataFrame(rows[3:4], schema).coalesce(1).write.mode("append").parquet(source)
    assert run("b") == [0, 1, 2, 3]  # a lost checkpoint
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.mode("append").parquet(source)
    assert run("a") == run("b") == [0, 1, 2, 3, 4]  # both go on
    assert spark.read.parquet(out).select("stream_id").distinct().count() == 2


def test_a_subscription_counts_from_the_next_batch(spark, tmp_path):
    schema = "id int, epic string, resolution string, type string, ts timestamp"
    table, source = str(tmp_path / "wanted"), str(tmp_path / "in")
    subscribe = lambda *r: spark.createDataFrame([r], "epic string, resolution string, type string").write.mode("append").parquet(table)
    now = dt.datetime(2026, 1, 1, tzinfo=UTC)

    def batch(*ids):
        kinds = [("A", "MINUTE", "classic"), ("A", "HOUR", "classic"), ("B", "MINUTE", "heikin"), ("B", "MINUTE", "classic")]
        spark.createDataFrame([(i, *kinds[i % 4], now) for i in ids], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        S.land(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "ts", once=True, change=S.live_subscription(table)).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    subscribe("A", "MINUTE", None)
    assert batch(0, 1, 2, 3) == [0]
    subscribe("B", None, "heikin")
    subscribe("B", "MINUTE", "heikin")  # matches the same rows, which stay single
    assert batch(4, 5, 6, 7) == [0, 4, 6]
