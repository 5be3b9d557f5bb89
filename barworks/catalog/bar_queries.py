"""Sources, bars and indicators over the given events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barworks.catalog import inputs as I
from barworks.catalog.registry import query, r
from barworks.functions.instants import iso_instant
from barworks.operators import bars as B
from barworks.operators.indicators import (
    Needs,
    indicator_frame,
    trend_slope,
    volume_ratio,
)
from barworks.operators.ordered import number_rows
from barworks.sources.quotes import (
    first_quotes,
    flatten_price_replies,
    quotes_between,
)

DEMO = I.DEMO
FRAME_SQL = (I.SQL_BARS, I.sql_recurrences(), I.sql_frame())


@query(
    "s1_first_quotes",
    I.with_sql(
        I.SQL_QUOTES,
        f"""SELECT id, epic, epoch_us(ts) AS snapshot_time_utc, {r('bid')} AS close_bid, {r('ask')} AS close_ask
        FROM quotes WHERE epic = 'view' ORDER BY ts, id LIMIT 500""",
    ),
)
def _(spark, d):
    """First 500 quotes of one instrument: a top-k listing, which is what the operator does."""
    return first_quotes(I.quotes(spark, d), "view", 500).select(
        "id", "epic", "snapshot_time_utc", "close_bid", "close_ask"
    )


@query(
    "s2_quotes_between",
    I.with_sql(
        I.SQL_QUOTES,
        f"""SELECT id, epoch_us(ts) AS snapshot_time_utc, {r('bid')} AS close_bid, {r('ask')} AS close_ask, volume
        FROM quotes WHERE epic = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""",
    ),
)
def _(spark, d):
    """Quotes of one instrument in a half-open window."""
    window = quotes_between(
        I.quotes(spark, d), "click", "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z"
    )
    return window.select(
        "id", "snapshot_time_utc", "close_bid", "close_ask", F.col("last_traded_volume").alias("volume")
    )


@query(
    "s3_flatten_price_replies",
    I.with_sql(
        I.SQL_QUOTES,
        f"""SELECT epic, epoch_us(date_trunc('second', ts)) AS snapshot_time_utc,
          max(round(bid, 2)) AS close_bid, count(*) * 0 + 1 AS rows
        FROM (SELECT *, row_number() OVER (PARTITION BY epic, date_trunc('second', ts) ORDER BY ts DESC, id DESC) AS rn
              FROM quotes) WHERE rn = 1 GROUP BY epic, ts""",
    ),
)
def _(spark, d):
    """Nested price replies built from all events, one per instrument and hour, flattened again."""
    q = I.quotes(spark, d)

    def leg(name):
        return F.struct(
            F.round(f"{name}_bid", 2).alias("bid"),
            F.round(f"{name}_ask", 2).alias("ask"),
            F.lit(None).cast("double").alias("lastTraded"),
        ).alias(f"{name}Price")

    whole = F.date_trunc("second", "snapshot_time_utc")
    item = F.struct(
        iso_instant(whole).alias("snapshotTimeUTC"),
        *[leg(n) for n in ("open", "close", "high", "low")],
        F.col("last_traded_volume").alias("lastTradedVolume"),
    )
    # One reply per event, as a broker may resend an instant; the last one sent wins.
    replies = q.select(
        F.col("snapshot_time_utc").alias("sent"),
        F.to_json(
            F.struct(F.col("epic"), F.lit("MINUTE").alias("resolution"), F.array(item).alias("prices"))
        ).alias("json"),
    )
    from barworks.schemas import PRICE_REPLY

    parsed = replies.select("sent", F.from_json("json", PRICE_REPLY).alias("p")).select("sent", "p.*")
    rows = flatten_price_replies(parsed, F.col("sent"), "replies")
    return rows.select("epic", "snapshot_time_utc", "close_bid", F.lit(1).alias("rows"))


@query(
    "b1_mid_prices",
    I.with_sql(I.SQL_QUOTES, f"SELECT id, epic, {r('(bid + ask) / 2')} AS o, {r('(bid + ask) / 2')} AS c FROM quotes"),
)
def _(spark, d):
    """Mid prices of every quote."""
    return B.mid_prices(I.quotes(spark, d)).select("id", "epic", "o", "c")


BARS_OUT = f"""SELECT epic, idx, begin_s * 1000000 AS begin_ts, end_s * 1000000 AS end_ts,
  {r('o')} AS o, {r('h')} AS h, {r('l')} AS l, {r('c')} AS c, {r('volume')} AS volume FROM bars"""


@query("b2_resample", I.with_sql(I.SQL_BARS, BARS_OUT))
def _(spark, d):
    """Hourly bars of every instrument, closed buckets only."""
    return I.bars(spark, d).drop("tf_min")


@query(
    "b2_resample_15min_open_bucket",
    I.with_sql(
        I.SQL_QUOTES,
        f"""SELECT epic, bucket * 1000000 AS begin_ts, {r('arg_min(mid, ts)')} AS o, {r('max(mid)')} AS h,
          {r('min(mid)')} AS l, {r('arg_max(mid, ts)')} AS c, count(*) * 0 + 15 AS tf_min
        FROM (SELECT epic, ts, (bid + ask) / 2 AS mid,
                CAST(floor((epoch_us(ts) - 60000000) / 900000000.0) AS BIGINT) * 900 AS bucket FROM quotes)
        GROUP BY epic, bucket""",
    ),
)
def _(spark, d):
    """15-minute bars with the last, still open bucket kept."""
    return B.resample(I.quotes(spark, d), 15, keep_open_bucket=True).select(
        "epic", "begin_ts", "o", "h", "l", "c", "tf_min"
    )


@query(
    "b3_bar_index",
    I.with_sql(I.SQL_BARS_USER, f"SELECT epic, idx, end_us AS end_ts, {r('c')} AS c FROM bars"),
)
def _(spark, d):
    """Dense position of every event in its user's series."""
    return I.bars_user(spark, d).select("epic", "idx", "end_ts", "c")


@query(
    "b3_line_position_in_part",
    """SELECT l_partkey, idx, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) - 1 AS idx
         FROM lineitem) GROUP BY l_partkey, idx""",
)
def _(spark, d):
    """The same numbering over line items of a part, chunked by ship year."""
    rows = number_rows(
        I.table(spark, d, "lineitem"),
        ["l_partkey"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"],
        [F.year("l_shipdate")],
    )
    return rows.groupBy("l_partkey", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty")
    )


@query(
    "b4_average_spread",
    I.with_sql(I.SQL_QUOTES, f"SELECT epic, {r('avg(ask - bid)')} AS avg_spread FROM quotes GROUP BY epic"),
)
def _(spark, d):
    """Average closing spread per instrument."""
    return B.average_spread(I.quotes(spark, d))


@query(
    "b5_trading_days",
    I.with_sql(
        I.SQL_BARS,
        "SELECT epic, count(DISTINCT CAST(to_timestamp(end_s) AT TIME ZONE 'UTC' AS DATE)) AS trading_days FROM bars GROUP BY epic",
    ),
)
def _(spark, d):
    """Distinct UTC dates of bar ends per instrument."""
    return B.trading_days(I.bars(spark, d))


@query(
    "b6_bar_at_or_after",
    I.with_sql(
        I.SQL_BARS,
        """marks AS (SELECT event_id, event_type AS epic, ts + INTERVAL 30 MINUTE AS at FROM events)""",
        """SELECT m.event_id, m.epic, coalesce(min(b.idx) FILTER (b.end_s * 1000000 >= epoch_us(m.at)), max(b.idx)) AS bar_idx
        FROM marks m JOIN bars b ON b.epic = m.epic GROUP BY m.event_id, m.epic""",
    ),
)
def _(spark, d):
    """For every event, the first bar that ends at or after it plus half an hour, else the last."""
    marks = I.table(spark, d, "events").select(
        "event_id",
        F.col("event_type").alias("epic"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 30 MINUTES")).alias("at"),
    )
    return B.index_at_or_after(marks, I.bars(spark, d), "at").select("event_id", "epic", "bar_idx")


@query(
    "b6_bar_at_or_after_hot_day",
    """WITH shifted AS (SELECT event_id, event_type AS epic,
      CASE WHEN event_id % 10 < 8 THEN TIMESTAMP '2026-01-01' + to_seconds(event_id % 900) ELSE ts END AS t FROM events),
    bars AS (SELECT epic, t, row_number() OVER (PARTITION BY epic ORDER BY t, event_id) - 1 AS idx FROM shifted)
    SELECT m.event_id, m.epic, coalesce(min(b.idx) FILTER (b.t >= m.t + INTERVAL 3 SECOND), max(b.idx)) AS bar_idx
    FROM shifted m JOIN bars b ON b.epic = m.epic GROUP BY m.event_id, m.epic""",
)
def _(spark, d):
    """The same over series of single events, of which a quarter of an hour holds four fifths."""
    rows = I.table(spark, d, "events").select(
        "event_id",
        F.col("event_type").alias("epic"),
        F.expr(
            "CASE WHEN event_id % 10 < 8 THEN timestamp'2026-01-01' + make_dt_interval(0, 0, 0, event_id % 900) ELSE CAST(ts AS TIMESTAMP) END"
        ).alias("end_ts"),
    )
    bars = number_rows(rows, ["epic"], ["end_ts", "event_id"], [F.expr("date_trunc('minute', end_ts)")])
    marks = rows.select("event_id", "epic", (F.col("end_ts") + F.expr("INTERVAL 3 SECONDS")).alias("at"))
    return B.index_at_or_after(marks, bars, "at").select("event_id", "epic", "bar_idx")


SPANS_SQL = """spans AS (
  SELECT epic, epic || '-' || CAST(idx AS VARCHAR) AS key, idx AS entry_idx,
         least(idx + idx % 40, max(idx) OVER (PARTITION BY epic)) AS exit_idx, h + 1 AS extra FROM bars)"""


def _spans(bars):
    last = F.max("idx").over(Window.partitionBy("epic"))
    return bars.select(
        "epic",
        F.concat_ws("-", "epic", F.col("idx").cast("string")).alias("key"),
        F.col("idx").alias("entry_idx"),
        F.least(F.col("idx") + F.col("idx") % 40, last).alias("exit_idx"),
        (F.col("h") + 1).alias("extra"),
    )


@query(
    "b7_bar_window",
    I.with_sql(
        I.SQL_BARS,
        SPANS_SQL,
        f"""SELECT key, count(*) AS bars, min(b.end_s) AS first_t, max(b.end_s) AS last_t,
          {r('sum(b.c)')} AS sum_c, {r('max(b.h)')} AS max_h
        FROM spans s JOIN bars b ON b.epic = s.epic AND b.idx BETWEEN s.entry_idx - 50 AND s.exit_idx + 50
        GROUP BY key""",
    ),
)
def _(spark, d):
    """Bar windows of 50 bars around a span that starts at every bar."""
    bars = I.bars(spark, d)
    windows = B.bar_window(_spans(bars), bars, "key")
    return windows.select(
        "key",
        F.size("bars").alias("bars"),
        F.element_at("bars", 1)["t"].alias("first_t"),
        F.element_at("bars", -1)["t"].alias("last_t"),
        F.aggregate("bars", F.lit(0.0), lambda a, b: a + b["c"]).alias("sum_c"),
        F.array_max(F.transform("bars", lambda b: b["h"])).alias("max_h"),
    )


@query(
    "b8_price_range",
    I.with_sql(
        I.SQL_BARS,
        SPANS_SQL,
        """agg AS (
          SELECT key, least(min(b.l), min(extra)) AS lo, greatest(max(b.h), max(extra)) AS hi
          FROM spans s JOIN bars b ON b.epic = s.epic AND b.idx BETWEEN s.entry_idx - 10 AND s.exit_idx + 10
          GROUP BY key)""",
        f"""SELECT key, {r('lo - CASE WHEN hi > lo THEN (hi - lo) * 0.02 ELSE 1 END')} AS range_min,
          {r('hi + CASE WHEN hi > lo THEN (hi - lo) * 0.02 ELSE 1 END')} AS range_max FROM agg""",
    ),
)
def _(spark, d):
    """Padded price range of a 10-bar focus window with one extra level."""
    bars = I.bars(spark, d)
    spans = _spans(bars)
    windows = B.bar_window(spans, bars, "key", 10, 10).join(spans.select("key", "extra"), "key")
    ranges = B.price_range(F.col("bars"), [F.col("extra")])
    return windows.select("key", *[c.alias(n) for n, c in ranges.items()])


@query(
    "b9_visible_range",
    I.with_sql(
        I.SQL_TRADES,
        """agg AS (SELECT run_id, direction, CAST(epoch(min(entry_day)) AS BIGINT) AS a,
             CAST(epoch(max(exit_day)) AS BIGINT) AS b FROM trades GROUP BY run_id, direction)""",
        """SELECT run_id, direction, a - greatest(1800, CAST(floor((b - a) / 4) AS BIGINT)) AS visible_from,
          b + greatest(1800, CAST(floor((b - a) / 4) AS BIGINT)) AS visible_to FROM agg""",
    ),
)
def _(spark, d):
    """Padded time range of the trades per run and direction."""
    return B.visible_range(I.trades(spark, d), ["run_id", "direction"])


def _bounded(**needs) -> Needs:
    return Needs(candles=False, context=False, **{k: frozenset(v) for k, v in needs.items()})


@query(
    "i1_sma",
    I.with_sql(
        *FRAME_SQL,
        f"""SELECT epic, idx, {r('mid_band')} AS sma_20, {r('volume_sma')} AS volume_sma_20,
          {r('rsi_sma')} AS rsi_sma FROM ind""",
    ),
)
def _(spark, d):
    """Moving averages of close, volume and RSI."""
    needs = _bounded(sma=[20], volume=[20], rsi=[7], rsi_sma=[(7, 5)])
    return indicator_frame(I.bars(spark, d), needs).select(
        "epic", "idx", "sma_20", "volume_sma_20", F.col("rsi_sma_7_5").alias("rsi_sma")
    )


@query(
    "i2_bollinger",
    I.with_sql(
        I.SQL_BARS_USER,
        f"""SELECT epic, idx, {r('avg(c) OVER w')} AS mid, {r('avg(c) OVER w - 2 * stddev_pop(c) OVER w')} AS lower,
          {r('avg(c) OVER w + 2 * stddev_pop(c) OVER w')} AS upper
        FROM bars WINDOW w AS (PARTITION BY epic ORDER BY idx ROWS 13 PRECEDING)""",
    ),
)
def _(spark, d):
    """Bollinger bands per user series."""
    out = indicator_frame(I.bars_user(spark, d), _bounded(bands=[(14, 2.0)]))
    return out.select(
        "epic", "idx", F.col("bb_mid_14").alias("mid"),
        F.col("bb_lower_14_2").alias("lower"), F.col("bb_upper_14_2").alias("upper"),
    )


@query(
    "i2_bollinger_sample",
    I.with_sql(
        I.SQL_BARS,
        f"""SELECT epic, idx, {r('avg(c) OVER w - 2 * coalesce(stddev_samp(c) OVER w, 0)')} AS lower,
          {r('avg(c) OVER w + 2 * coalesce(stddev_samp(c) OVER w, 0)')} AS upper
        FROM bars WINDOW w AS (PARTITION BY epic ORDER BY idx ROWS 19 PRECEDING)""",
    ),
)
def _(spark, d):
    """Bollinger bands with the sample deviation."""
    needs = Needs(candles=False, context=False, bands=frozenset({(20, 2.0)}), band_ddof=1)
    return indicator_frame(I.bars(spark, d), needs).select(
        "epic", "idx", F.col("bb_lower_20_2").alias("lower"), F.col("bb_upper_20_2").alias("upper")
    )


@query(
    "i3_true_range",
    I.with_sql(I.SQL_BARS, I.sql_recurrences(), f"SELECT epic, idx, {r('tr')} AS tr FROM moves"),
)
def _(spark, d):
    """True range of every bar."""
    return indicator_frame(I.bars(spark, d), _bounded(atr=[14])).select("epic", "idx", "tr")


@query(
    "i4_swing_levels",
    I.with_sql(*FRAME_SQL, f"SELECT epic, idx, {r('lowest')} AS lowest, {r('highest')} AS highest FROM ind"),
)
def _(spark, d):
    """Lowest and highest close of the last 10 bars."""
    out = indicator_frame(I.bars(spark, d), _bounded(swing=[10]))
    return out.select(
        "epic", "idx", F.col("lowest_10").alias("lowest"), F.col("highest_10").alias("highest")
    )


@query(
    "i5_prior_levels",
    I.with_sql(
        *FRAME_SQL, f"SELECT epic, idx, {r('prior_low')} AS prior_low, {r('prior_high')} AS prior_high FROM ind"
    ),
)
def _(spark, d):
    """The swing levels one bar earlier."""
    out = indicator_frame(I.bars(spark, d), _bounded(swing=[10]))
    return out.select(
        "epic", "idx", F.col("prior_low_10").alias("prior_low"), F.col("prior_high_10").alias("prior_high")
    )


@query(
    "i6_atr_percentile",
    I.with_sql(*FRAME_SQL, f"SELECT epic, idx, {r('atr_rank')} AS atr_percentile FROM shapes"),
)
def _(spark, d):
    """Trailing percentile rank of the ATR."""
    return I.frame(spark, d).select("epic", "idx", F.col("atr_rank_14").alias("atr_percentile"))


@query("i7_volatility_regime", I.with_sql(*FRAME_SQL, "SELECT epic, idx, regime FROM shapes"))
def _(spark, d):
    """LOW, NORMAL or HIGH against the last 20 bars."""
    return I.frame(spark, d).select("epic", "idx", F.col("regime_14").alias("regime"))


@query(
    "i8_trend_slope",
    I.with_sql(
        *FRAME_SQL,
        f"""SELECT epic, idx, {r('(trend - trend_back) / nullif(greatest(1, least(10, idx)) * atr, 0)')} AS slope
        FROM ind""",
    ),
)
def _(spark, d):
    """EMA change per bar in ATR."""
    return I.frame(spark, d).select("epic", "idx", F.expr(trend_slope("ema_move_30", "idx", "atr_14")).alias("slope"))


@query(
    "i9_volume_ratio",
    I.with_sql(*FRAME_SQL, f"SELECT epic, idx, {r('volume / nullif(volume_sma, 0)')} AS volume_ratio FROM ind"),
)
def _(spark, d):
    """Volume against its moving average."""
    return I.frame(spark, d).select("epic", "idx", F.expr(volume_ratio(20)).alias("volume_ratio"))


@query(
    "r1_ema",
    I.with_sql(I.SQL_BARS, I.sql_recurrences(), f"SELECT epic, idx, {r('ema')} AS ema_12, {r('trend')} AS ema_30 FROM rec"),
)
def _(spark, d):
    """Fast and slow EMA of the hourly bars."""
    return indicator_frame(I.bars(spark, d), _bounded(ema=[12, 30])).select("epic", "idx", "ema_12", "ema_30")


@query(
    "r1_ema_user_series",
    I.with_sql(I.SQL_BARS_USER, I.sql_recurrences(), f"SELECT epic, idx, {r('ema')} AS ema_12 FROM rec"),
)
def _(spark, d):
    """EMA of every user's own event series: many short series."""
    return indicator_frame(I.bars_user(spark, d), _bounded(ema=[12])).select("epic", "idx", "ema_12")


@query(
    "r2_rsi",
    I.with_sql(I.SQL_BARS, I.sql_recurrences(), f"SELECT epic, idx, {r('rsi')} AS rsi_7 FROM smooth"),
)
def _(spark, d):
    """RSI with Wilder smoothing."""
    return indicator_frame(I.bars(spark, d), _bounded(rsi=[7])).select("epic", "idx", "rsi_7")


@query(
    "r3_atr",
    I.with_sql(I.SQL_BARS, I.sql_recurrences(), f"SELECT epic, idx, {r('atr')} AS atr_14 FROM rec"),
)
def _(spark, d):
    """Average true range."""
    return indicator_frame(I.bars(spark, d), _bounded(atr=[14])).select("epic", "idx", "atr_14")


@query(
    "r4_smoothed_rsi",
    I.with_sql(*FRAME_SQL, f"SELECT epic, idx, {r('rsi_sma')} AS rsi_sma FROM ind"),
)
def _(spark, d):
    """Moving average of the RSI."""
    needs = _bounded(rsi=[7], rsi_sma=[(7, 5)])
    return indicator_frame(I.bars(spark, d), needs).select(
        "epic", "idx", F.col("rsi_sma_7_5").alias("rsi_sma")
    )


@query(
    "r_scan_across_segments",
    I.with_sql(
        I.SQL_BARS, I.sql_recurrences(), f"SELECT epic, idx, {r('trend')} AS ema_30, {r('atr')} AS atr_14, {r('rsi')} AS rsi_7 FROM smooth"
    ),
)
def _(spark, d):
    """The recurrences cut into 64-bar segments, so that values are carried across many of them."""
    needs = _bounded(ema=[30], atr=[14], rsi=[7])
    return indicator_frame(I.bars(spark, d), needs, size=64).select(
        "epic", "idx", "ema_30", "atr_14", "rsi_7"
    )


def _candle(name: str, column: str, sql_column: str):
    @query(name, I.with_sql(*FRAME_SQL, f"SELECT epic, idx, {sql_column} AS fired FROM shapes"))
    def _(spark, d):
        return indicator_frame(I.bars(spark, d), Needs(context=False)).select(
            "epic", "idx", F.col(column).alias("fired")
        )


_candle("c1_bullish_engulfing", "bullish_engulfing", "bull_engulf")
_candle("c2_bearish_engulfing", "bearish_engulfing", "bear_engulf")
_candle("c3_bullish_harami", "bullish_harami", "bull_harami")
_candle("c4_bearish_harami", "bearish_harami", "bear_harami")
_candle("c5_hammer", "hammer", "hammer")
_candle("c6_shooting_star", "shooting_star", "shooting")
