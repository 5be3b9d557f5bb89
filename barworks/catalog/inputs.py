"""The given tables read as quotes, bars, trades and annotations, for Spark and for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barworks.operators.bars import resample, rows_as_bars
from barworks.operators.indicators import indicator_frame, needs_of
from barworks.plans.arms import Arm, thirds, variant
from barworks.sources.quotes import quotes_from_events

MINUTES = 60

# Short periods, so that the month of hourly bars in the given events has many settled rows.
DEMO = Arm(
    name="demo",
    rsi_period=7,
    rsi_smooth_period=5,
    bb_period=20,
    bb_multiplier=1.5,
    ema_period=12,
    atr_period=14,
    rsi_oversold=45.0,
    rsi_overbought=55.0,
    stop_atr=1.5,
    target_atr=0.75,
    max_holding_bars=0,
    trend_ema_period=30,
    trend_ema_max_atr=0.0,
    confluence_threshold=2,
    proximity_atr=0.5,
    swing_lookback_bars=10,
    volume_sma_period=20,
    enable_structure=True,
    enable_short=True,
)
CONTROL = variant(DEMO, "control", trend_ema_max_atr=1.5, max_holding_bars=24)
DEMO_GRID = [
    DEMO,
    CONTROL,
    variant(DEMO, "strict", confluence_threshold=3, max_holding_bars=48),
    variant(DEMO, "long_only_wide", enable_short=False, stop_atr=3.0, target_atr=0.5),
    variant(CONTROL, "ladder_none", tiers=thirds(3.0), ratchet="NONE"),
    variant(CONTROL, "ladder_breakeven", tiers=thirds(2.0), ratchet="BREAKEVEN_AFTER_T1"),
    variant(CONTROL, "ladder_lagged", tiers=thirds(2.0), ratchet="LAGGED"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_from_events(table(spark, sf_dir, "events"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(quotes(spark, sf_dir), MINUTES)


def bars_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rows_as_bars(events, F.col("user_id").cast("string"), "ts", "value", "event_id")


def frame(spark: SparkSession, sf_dir: str, arms: list[Arm] | None = None) -> DataFrame:
    return indicator_frame(bars(spark, sf_dir), needs_of(arms or [DEMO]))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as trades: priority is the run, pnl comes from the key, exit is 1 to 10 days on."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pnl = ((key * 37) % 1000 - 480) / F.lit(100.0)
    long = key % 2 == 0
    return o.select(
        F.col("o_orderpriority").alias("run_id"),
        key.alias("trade_id"),
        F.concat_ws("|", "o_orderpriority", key.cast("string")).alias("signal_key"),
        F.col("o_orderdate").cast("timestamp").alias("entry_ts"),
        F.date_add("o_orderdate", (key % 10 + 1).cast("int")).cast("timestamp").alias("exit_ts"),
        F.when(long, "LONG").otherwise("SHORT").alias("direction"),
        F.col("o_orderstatus").alias("volatility_regime"),
        pnl.alias("pnl"),
        (pnl - 0.04794123).alias("net_pnl"),
        (pnl / (key % 3 + 1)).alias("r_multiple"),
        (pnl > 0).alias("is_win"),
        ((key * 13) % 4 > 0).alias("hit_t1"),
        F.col("o_totalprice").alias("atr_value"),
        F.when(key % 7 > 0, F.col("o_totalprice") / 1000 - (key % 100)).alias("dist_to_trend_ema_atr"),
        (key % 24).cast("int").alias("hour_utc"),
        (key * 29 % 10007 / F.lit(100.07)).alias("rsi_value"),
        (key * 17 % 4001 / F.lit(1000.0) - 1).alias("dist_to_bb_lower_atr"),
        (3 - key * 17 % 4001 / F.lit(1000.0)).alias("dist_to_bb_upper_atr"),
        F.pow(F.lit(10.0), key * 31 % 613 / F.lit(100.0) - 3).alias("dist_to_support_atr"),
        # One value is that of two thirds of all trades.
        F.when(key % 3 > 0, 0.25).otherwise(key % 997 / F.lit(8.0)).alias("dist_to_resistance_atr"),
        ((key % 201 - 100) / F.lit(64.0)).alias("trend_slope_atr"),
        F.when(key % 11 > 0, key * 7 % 101 / F.lit(101.0)).alias("atr_percentile"),
        F.when(key % 13 > 0, key % 50 / F.lit(10.0)).otherwise(F.lit(float("nan"))).alias("volume_ratio"),
        (key % 5 + 1).cast("int").alias("day_of_week"),
        (key % 4 + 1).cast("int").alias("confluence_score"),
    )


def order_chunk() -> list:
    """Entry day, then blocks of keys: follows (entry_ts, trade_id) and bounds a chunk's rows."""
    return [F.to_date("entry_ts"), F.floor(F.col("trade_id") / 1_000_000)]


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("signal_key"),
        F.col("event_type").alias("flag"),
        F.col("props").alias("note"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_id").alias("id"),
    )


def mark_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("signal_key"),
        F.concat(F.lit("T"), (F.col("event_id") % 3 + 1).cast("string")).alias("kind"),
        F.col("ts").cast("timestamp").alias("bar_ts"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_id").alias("id"),
        (F.col("event_type") == "error").alias("deleted"),
    )


# ---- The same inputs in SQL ---------------------------------------------------------------

SQL_QUOTES = """quotes AS (
  SELECT event_id AS id, event_type AS epic, ts,
         value - 0.01::DOUBLE * (1 + event_id % 5) AS bid,
         value + 0.01::DOUBLE * (1 + event_id % 5) AS ask,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS volume
  FROM events)"""

def sql_bars(minutes: int = MINUTES) -> str:
    seconds = minutes * 60
    return f"""{SQL_QUOTES},
ticks AS (
  SELECT epic, id, ts, (bid + ask) / 2 AS mid, volume,
         CAST(floor((epoch_us(ts) - 60000000) / {seconds}000000.0) AS BIGINT) * {seconds} AS bucket
  FROM quotes),
grouped AS (
  SELECT epic, bucket, arg_min(mid, ts) AS o, max(mid) AS h, min(mid) AS l, arg_max(mid, ts) AS c,
         CAST(sum(volume) AS DOUBLE) AS volume
  FROM ticks GROUP BY epic, bucket),
passed AS (SELECT epic, max(epoch_us(ts)) AS last_us FROM quotes GROUP BY epic),
bars AS (
  SELECT g.epic, row_number() OVER (PARTITION BY g.epic ORDER BY bucket) - 1 AS idx,
         bucket AS begin_s, bucket + {seconds} AS end_s, o, h, l, c, g.volume
  FROM grouped g JOIN passed p ON p.epic = g.epic
  WHERE (bucket + {seconds}) * 1000000 <= p.last_us)"""


SQL_BARS = sql_bars()

SQL_BARS_USER = """bars AS (
  SELECT CAST(user_id AS VARCHAR) AS epic,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         epoch_us(ts) AS end_us, value AS o, value AS h, value AS l, value AS c
  FROM events)"""


def sql_recurrences(arm: Arm = DEMO) -> str:
    """Step-by-step recurrences over ``bars``, as a recursive query."""

    def step(col: str, new: str, alpha: str) -> str:
        return f"p.{col} + ({alpha}) * (i.{new} - p.{col})"

    fast = f"2.0::DOUBLE / {arm.ema_period + 1}"
    slow = f"2.0::DOUBLE / {(arm.trend_ema_period or arm.ema_period) + 1}"
    wilder = f"1.0::DOUBLE / {arm.rsi_period}"
    atr = f"1.0::DOUBLE / {arm.atr_period}"
    return f"""lagged AS (
  SELECT *, lag(c) OVER (PARTITION BY epic ORDER BY idx) AS pc FROM bars),
moves AS (
  SELECT *, coalesce(greatest(c - pc, 0), 0) AS up, coalesce(greatest(pc - c, 0), 0) AS down,
         CASE WHEN pc IS NULL THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr
  FROM lagged),
rec AS (
  SELECT epic, idx, c AS ema, c AS trend, up AS gain, down AS loss, tr AS atr FROM moves WHERE idx = 0
  UNION ALL
  SELECT i.epic, i.idx, {step("ema", "c", fast)}, {step("trend", "c", slow)},
         {step("gain", "up", wilder)}, {step("loss", "down", wilder)}, {step("atr", "tr", atr)}
  FROM rec p JOIN moves i ON i.epic = p.epic AND i.idx = p.idx + 1),
smooth AS (
  SELECT m.*, r.ema, r.trend, r.atr,
         CASE WHEN r.loss = 0 THEN CASE WHEN r.gain > 0 THEN 100.0 ELSE 0.0 END
              ELSE 100.0 - 100.0 / (1.0 + r.gain / r.loss) END AS rsi
  FROM moves m JOIN rec r ON r.epic = m.epic AND r.idx = m.idx)"""


def sql_frame(arm: Arm = DEMO) -> str:
    """Every indicator of an arm over ``smooth``."""
    bb, sw, vs = arm.bb_period, arm.swing_lookback_bars, arm.volume_sma_period
    return f"""ind AS (
  SELECT *,
    avg(rsi) OVER (w ROWS {arm.rsi_smooth_period - 1} PRECEDING) AS rsi_sma,
    avg(c) OVER (w ROWS {bb - 1} PRECEDING) AS mid_band,
    avg(c) OVER (w ROWS {bb - 1} PRECEDING)
      - {arm.bb_multiplier}::DOUBLE * stddev_pop(c) OVER (w ROWS {bb - 1} PRECEDING) AS lower_band,
    avg(c) OVER (w ROWS {bb - 1} PRECEDING)
      + {arm.bb_multiplier}::DOUBLE * stddev_pop(c) OVER (w ROWS {bb - 1} PRECEDING) AS upper_band,
    min(c) OVER (w ROWS {sw - 1} PRECEDING) AS lowest,
    max(c) OVER (w ROWS {sw - 1} PRECEDING) AS highest,
    min(c) OVER (w ROWS BETWEEN {sw} PRECEDING AND 1 PRECEDING) AS prior_low,
    max(c) OVER (w ROWS BETWEEN {sw} PRECEDING AND 1 PRECEDING) AS prior_high,
    avg(volume) OVER (w ROWS {vs - 1} PRECEDING) AS volume_sma,
    avg(c) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prior_mean,
    lag(o) OVER (w) AS po,
    list_sort(list(atr) OVER (w ROWS 19 PRECEDING)) AS atr20,
    list(atr) OVER (w ROWS 99 PRECEDING) AS atr100,
    first_value(ema) OVER (w ROWS 10 PRECEDING) AS ema_back,
    first_value(trend) OVER (w ROWS 10 PRECEDING) AS trend_back,
    lead(c) OVER (w) AS next_c, lead(atr) OVER (w) AS next_atr, lead(end_s) OVER (w) AS next_end_s,
    max(idx) OVER (PARTITION BY epic) AS last_idx
  FROM smooth WINDOW w AS (PARTITION BY epic ORDER BY idx)),
shapes AS (
  SELECT *,
    coalesce(pc < po AND c > o AND o < least(po, pc) AND c > greatest(po, pc), false) AS bull_engulf,
    coalesce(pc > po AND c < o AND o > greatest(po, pc) AND c < least(po, pc), false) AS bear_engulf,
    coalesce(pc < po AND c > o AND o > pc AND c < po, false) AS bull_harami,
    coalesce(pc > po AND c < o AND o < pc AND c > po, false) AS bear_harami,
    coalesce(c <> o AND least(o, c) - l >= 2 * abs(c - o) AND h - greatest(o, c) <= 0.5 * abs(c - o)
             AND c < prior_mean, false) AS hammer,
    coalesce(c <> o AND h - greatest(o, c) >= 2 * abs(c - o) AND least(o, c) - l <= 0.5 * abs(c - o)
             AND c > prior_mean, false) AS shooting,
    CASE WHEN atr <= atr20[CAST(floor((len(atr20) - 1) * 0.2) AS INTEGER) + 1] THEN 'LOW'
         WHEN atr >= atr20[CAST(floor((len(atr20) - 1) * 0.8) AS INTEGER) + 1] THEN 'HIGH'
         ELSE 'NORMAL' END AS regime,
    len(list_filter(atr100, lambda x: x <= atr)) / len(atr100)::DOUBLE AS atr_rank
  FROM ind)"""


def sql_arms(arms: list[Arm]) -> str:
    first: dict[str, int] = {}
    rows = []
    for i, a in enumerate(arms):
        entry = first.setdefault(a.entry_config, i)
        fractions = ", ".join(repr(t.fraction) for t in a.exit_ladder)
        targets = ", ".join(repr(t.target_atr) for t in a.exit_ladder)
        rows.append(
            f"({i}, '{a.name}', {entry}, {a.confluence_threshold}, {a.stop_atr}::DOUBLE, "
            f"{a.target_atr}::DOUBLE, {a.max_holding_bars}, {a.enable_long}, {a.enable_short}, "
            f"{a.trend_ema_max_atr}::DOUBLE, '{a.ratchet}', [{fractions}]::DOUBLE[], [{targets}]::DOUBLE[])"
        )
    return (
        "arms(arm_id, label, entry_id, threshold, stop_m, target_m, max_hold, longs, shorts, reach, "
        "ratchet, fractions, targets) AS (VALUES " + ",\n  ".join(rows) + ")"
    )


def sql_signals(arm: Arm = DEMO) -> str:
    """Entry signals per entry config and direction; the arms share all periods."""
    warm = arm.warm_up
    above, below = ("c > trend", "c < trend") if arm.trend_ema_period > 0 else ("true", "true")
    v_break = (
        "coalesce(CASE WHEN d.direction = 'LONG' THEN c > prior_high ELSE c < prior_low END, false)"
        if arm.enable_structure
        else "false"
    )
    return f"""votes AS (
  SELECT s.*, d.direction, d.direction = 'LONG' AS is_long,
    CASE WHEN d.direction = 'LONG' THEN rsi < {arm.rsi_oversold} AND c <= lower_band
         ELSE rsi > {arm.rsi_overbought} AND c >= upper_band END AS v_rsi,
    CASE WHEN d.direction = 'LONG' THEN bull_engulf OR bull_harami OR hammer
         ELSE bear_engulf OR bear_harami OR shooting END AS v_candle,
    abs(c - CASE WHEN d.direction = 'LONG' THEN lowest ELSE highest END)
      < {arm.proximity_atr} * atr AS v_level,
    {v_break} AS v_break,
    volume > volume_sma AND CASE WHEN d.direction = 'LONG' THEN c > ema ELSE c < ema END AS v_volume
  FROM shapes s CROSS JOIN (VALUES ('LONG'), ('SHORT')) d(direction)),
scored AS (
  SELECT *, v_rsi::INT + v_candle::INT + v_level::INT + v_break::INT + v_volume::INT AS score,
    concat_ws('+', CASE WHEN v_rsi THEN 'RSI+BB' END, CASE WHEN v_candle THEN 'Candle' END,
      CASE WHEN v_level THEN 'S/R' END, CASE WHEN v_break THEN 'Structure' END,
      CASE WHEN v_volume THEN 'Vol+Trend' END) AS reasons
  FROM votes),
sig AS (
  SELECT a.arm_id, a.stop_m, a.target_m, a.max_hold, s.epic, s.direction, s.is_long, s.idx AS signal_idx,
    s.idx + 1 AS entry_idx, s.next_c AS entry_price, s.next_atr AS entry_atr, s.next_end_s AS entry_s,
    s.score, s.reasons, s.last_idx
  FROM scored s JOIN arms a ON a.arm_id = a.entry_id AND s.score >= a.threshold
  WHERE s.idx >= {warm} AND s.next_c IS NOT NULL
    AND CASE WHEN is_long THEN a.longs AND {above} AND (a.reach = 0 OR c < trend + a.reach * atr)
             ELSE a.shorts AND {below} AND (a.reach = 0 OR c > trend - a.reach * atr) END)"""


SQL_TAKEN = """sg AS (SELECT *, CASE WHEN is_long THEN 1.0 ELSE -1.0 END::DOUBLE AS sgn FROM sig),
reached AS (
  SELECT g.arm_id, g.epic, g.direction, g.signal_idx, min(b.idx) AS at
  FROM sg g JOIN bars b ON b.epic = g.epic AND b.idx > g.entry_idx
    AND (g.sgn * (b.c - (g.entry_price - g.sgn * g.stop_m * g.entry_atr)) <= 0
      OR g.sgn * (b.c - (g.entry_price + g.sgn * g.target_m * g.entry_atr)) >= 0)
  GROUP BY ALL),
gated AS (
  SELECT g.*, CASE WHEN least(r.at, CASE WHEN max_hold > 0 THEN entry_idx + max_hold END) < last_idx
              THEN least(r.at, CASE WHEN max_hold > 0 THEN entry_idx + max_hold END) END AS gate_idx
  FROM sg g LEFT JOIN reached r USING (arm_id, epic, direction, signal_idx)),
linked AS (
  SELECT g.arm_id, g.epic, g.direction, g.signal_idx, min(n.signal_idx) AS next_idx
  FROM gated g LEFT JOIN gated n ON n.arm_id = g.arm_id AND n.epic = g.epic
    AND n.direction = g.direction AND n.signal_idx > g.gate_idx
  GROUP BY ALL),
chain AS (
  SELECT arm_id, epic, direction, min(signal_idx) AS signal_idx FROM gated GROUP BY ALL
  UNION ALL
  SELECT c.arm_id, c.epic, c.direction, l.next_idx
  FROM chain c JOIN linked l USING (arm_id, epic, direction, signal_idx)
  WHERE l.next_idx IS NOT NULL),
taken AS (
  SELECT g.* FROM gated g JOIN chain USING (arm_id, epic, direction, signal_idx)
  WHERE gate_idx IS NOT NULL)"""


def sql_outcomes(source: str = "taken") -> str:
    """Bar-by-bar walk of every event of ``source`` for every arm that shares its entries."""
    return f"""walk AS (
  SELECT a.arm_id, a.label, t.epic, t.direction, t.is_long, t.signal_idx, t.entry_idx, t.entry_price,
    t.entry_atr, t.entry_s, t.last_idx, t.sgn, a.max_hold, a.ratchet, a.fractions, a.targets,
    a.stop_m * t.entry_atr AS stop_dist,
    t.entry_idx AS i, 0 AS n, t.entry_price - t.sgn * a.stop_m * t.entry_atr AS stop_at,
    CASE WHEN t.entry_idx = t.last_idx THEN 0.0 ELSE 1.0 END::DOUBLE AS left_over,
    CASE WHEN t.entry_idx = t.last_idx THEN e.c ELSE 0.0 END::DOUBLE AS acc,
    CASE WHEN t.entry_idx = t.last_idx THEN 'END' END AS reason
  FROM {source} t JOIN arms a ON a.entry_id = t.arm_id
    JOIN bars e ON e.epic = t.epic AND e.idx = t.entry_idx
  UNION ALL
  SELECT arm_id, label, epic, direction, is_long, signal_idx, entry_idx, entry_price, entry_atr, entry_s,
    last_idx, sgn, max_hold, ratchet, fractions, targets, stop_dist, i, m,
    CASE WHEN ratchet = 'BREAKEVEN_AFTER_T1' AND m >= 2 THEN entry_price + sgn * targets[1] * entry_atr
         WHEN ratchet = 'BREAKEVEN_AFTER_T1' AND m >= 1 THEN entry_price
         WHEN ratchet = 'LAGGED' AND m >= 2 THEN entry_price ELSE stop_at END,
    left_over - banked,
    acc + CASE WHEN stopped THEN left_over * stop_at
               WHEN m = len(targets) THEN gained
               WHEN timed THEN gained + (left_over - banked) * close
               WHEN i = last_idx THEN gained + (left_over - banked) * close ELSE gained END,
    CASE WHEN stopped THEN 'STOP' WHEN m = len(targets) THEN 'TARGET' WHEN timed THEN 'TIME'
         WHEN i = last_idx THEN 'END' END
  FROM (
    SELECT *, coalesce(list_sum(list_transform(range(n + 1, m + 1),
                lambda j: fractions[j] * (entry_price + sgn * targets[j] * entry_atr))), 0) AS gained,
      coalesce(list_sum(fractions[n + 1 : m]), 0) AS banked
    FROM (
      SELECT *, CASE WHEN stopped THEN n ELSE greatest(n, len(list_filter(targets,
          lambda t: CASE WHEN is_long THEN hi >= entry_price + t * entry_atr
                         ELSE lo <= entry_price - t * entry_atr END))) END AS m
      FROM (
        SELECT w.* EXCLUDE (i), b.idx AS i, b.h AS hi, b.l AS lo, b.c AS close,
          CASE WHEN w.is_long THEN b.l <= w.stop_at ELSE b.h >= w.stop_at END AS stopped,
          w.max_hold > 0 AND b.idx - w.entry_idx >= w.max_hold AS timed
        FROM walk w JOIN bars b ON b.epic = w.epic AND b.idx = w.i + 1
        WHERE w.reason IS NULL)))),
closed AS (
  SELECT *, i AS exit_idx, acc AS exit_price, sgn * (acc - entry_price) AS pnl,
    CASE WHEN stop_dist = 0 THEN entry_atr ELSE stop_dist END AS risk
  FROM walk WHERE reason IS NOT NULL)"""


SQL_TRADES = """trades AS (
  SELECT o_orderpriority AS run_id, o_orderkey AS trade_id,
    o_orderpriority || '|' || CAST(o_orderkey AS VARCHAR) AS signal_key,
    CAST(o_orderdate AS DATE) AS entry_day,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 + 1 AS INTEGER) AS exit_day,
    CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
    o_orderstatus AS volatility_regime,
    ((o_orderkey * 37) % 1000 - 480) / 100.0::DOUBLE AS pnl,
    ((o_orderkey * 37) % 1000 - 480) / 100.0::DOUBLE - 0.04794123::DOUBLE AS net_pnl,
    ((o_orderkey * 37) % 1000 - 480) / 100.0::DOUBLE / (o_orderkey % 3 + 1) AS r_multiple,
    ((o_orderkey * 37) % 1000 - 480) > 0 AS is_win,
    (o_orderkey * 13) % 4 > 0 AS hit_t1,
    o_totalprice AS atr_value,
    CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 1000 - (o_orderkey % 100) END AS dist_to_trend_ema_atr,
    CAST(o_orderkey % 24 AS BIGINT) AS hour_utc,
    o_orderkey * 29 % 10007 / 100.07::DOUBLE AS rsi_value,
    o_orderkey * 17 % 4001 / 1000.0::DOUBLE - 1 AS dist_to_bb_lower_atr,
    3 - o_orderkey * 17 % 4001 / 1000.0::DOUBLE AS dist_to_bb_upper_atr,
    pow(10.0::DOUBLE, o_orderkey * 31 % 613 / 100.0::DOUBLE - 3) AS dist_to_support_atr,
    CASE WHEN o_orderkey % 3 > 0 THEN 0.25::DOUBLE ELSE o_orderkey % 997 / 8.0::DOUBLE END AS dist_to_resistance_atr,
    (o_orderkey % 201 - 100) / 64.0::DOUBLE AS trend_slope_atr,
    CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey * 7 % 101 / 101.0::DOUBLE END AS atr_percentile,
    CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 50 / 10.0::DOUBLE END AS volume_ratio,
    CAST(o_orderkey % 5 + 1 AS BIGINT) AS day_of_week,
    CAST(o_orderkey % 4 + 1 AS BIGINT) AS confluence_score,
    CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS q
  FROM orders)"""

SQL_FEEDBACK = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS signal_key, event_type AS flag, props AS note,
         epoch_us(ts) AS created_at, event_id AS id FROM events)"""

SQL_MARKS = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS signal_key, 'T' || CAST(event_id % 3 + 1 AS VARCHAR) AS kind,
         epoch_us(ts) AS bar_ts, epoch_us(ts) AS created_at, event_id AS id,
         event_type = 'error' AS deleted FROM events),
last_marks AS (
  SELECT signal_key, kind, bar_ts, created_at, id FROM (
    SELECT *, row_number() OVER (PARTITION BY signal_key, kind ORDER BY created_at DESC, id DESC) AS rn
    FROM log) WHERE rn = 1 AND NOT deleted)"""


def with_sql(*parts: str) -> str:
    """CTEs and a final SELECT."""
    *ctes, body = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body
