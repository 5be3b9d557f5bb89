"""The given events as a file stream, run to the end and read back from its table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barworks.catalog import inputs as I
from barworks.catalog.registry import query, r
from barworks.session import shared_dir
from barworks.streaming import ticks as S
from barworks.streaming.live_indicators import live_indicators, on_time

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def event_stream(spark, d):
    rows = (
        spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(d)
    )
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def message_stream(spark, d):
    """Every event as a JSON envelope; some are errors, some pings."""
    kind = F.col("event_type")
    payload = F.struct(
        kind.alias("epic"),
        F.lit("CFD").alias("product"),
        (F.col("value") - 0.01).alias("bid"),
        F.lit(1.0).alias("bidQty"),
        (F.col("value") + 0.01).alias("ofr"),
        F.lit(1.0).alias("ofrQty"),
        F.unix_millis("ts").alias("timestamp"),
    )
    envelope = F.struct(
        F.when(kind == "error", "ERROR").otherwise("OK").alias("status"),
        F.when(F.col("event_id") % 10 == 0, "ping").otherwise("quote").alias("destination"),
        F.col("event_id").cast("string").alias("correlationId"),
        payload.alias("payload"),
    )
    return event_stream(spark, d).select(F.to_json(envelope).alias("value"))


def run_to_end(spark, rows, write=S.to_table):
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = write(rows, f"{root}/table", f"{root}/checkpoint", once=True)
    run.awaitTermination()
    return spark.read.parquet(f"{root}/table")


TICK_SQL = """ticks AS (
  SELECT event_id, event_type AS epic, epoch_us(ts) // 1000 AS ms, value - 0.01::DOUBLE AS bid, value + 0.01::DOUBLE AS ofr
  FROM events WHERE event_type <> 'error' AND event_id % 10 <> 0)"""


@query(
    "t1_parsed_messages",
    I.with_sql(
        TICK_SQL,
        f"""SELECT CAST(event_id AS VARCHAR) AS correlation_id, epic, {r('bid')} AS bid, {r('ofr')} AS ofr,
          ms * 1000 AS ts FROM ticks""",
    ),
)
def _(spark, d):
    """OK quote messages; errors and pings fall away."""
    ticks = S.parse_messages(message_stream(spark, d), "quote")
    return run_to_end(spark, ticks).select("correlation_id", "epic", "bid", "ofr", "ts")


@query(
    "t2_subscribed",
    I.with_sql(
        TICK_SQL,
        """SELECT CAST(event_id AS VARCHAR) AS correlation_id, epic FROM ticks
        WHERE (epic = 'click' AND event_id % 3 <> 0) OR (epic = 'view' AND event_id % 2 = 0)""",
    ),
)
def _(spark, d):
    """Messages of subscribed instruments, resolutions and types, by list and by a table that every
    micro-batch reads anew."""
    number = F.col("correlation_id").cast("long")
    ticks = S.parse_messages(message_stream(spark, d), "quote").withColumns(
        {
            "resolution": F.when(number % 3 == 0, "HOUR").otherwise("MINUTE"),
            "type": F.when(number % 2 == 0, "classic").otherwise("heikin-ashi"),
        }
    )
    listed = S.subscribed(ticks, S.Subscription(("click", "view", "purchase"), ("MINUTE", "HOUR")))
    table = I.table(spark, d, "events").where("event_type IN ('click', 'view')").selectExpr(
        "event_type AS epic", "CASE WHEN event_type = 'click' THEN 'MINUTE' END AS resolution",
        "CASE WHEN event_type = 'view' THEN 'classic' END AS type",
    )
    path = f"{shared_dir(spark)}/subscriptions-{uuid.uuid4().hex}"
    table.distinct().write.parquet(path)

    def land(rows, path_, checkpoint, once):
        return S.land(rows, path_, checkpoint, "ts", once, ["correlation_id"], S.live_subscription(path))

    return run_to_end(spark, listed, land).select("correlation_id", "epic")


@query(
    "t3_tick_bars",
    I.with_sql(
        TICK_SQL,
        f"""SELECT epic, (ms // 3600000) * 3600000000 AS begin_ts, {r('arg_min((bid + ofr) / 2, ms)')} AS o,
          {r('max((bid + ofr) / 2)')} AS h, {r('min((bid + ofr) / 2)')} AS l, {r('arg_max((bid + ofr) / 2, ms)')} AS c,
          {r('count(*)')} AS volume
        FROM ticks GROUP BY epic, ms // 3600000
        HAVING (ms // 3600000) * 3600000 + 3600000 <= (SELECT max(ms) FROM ticks) - 600000""",
    ),
)
def _(spark, d):
    """Hourly bars from the tick stream; windows behind the watermark are closed."""
    ticks = S.parse_messages(message_stream(spark, d), "quote")
    bars = S.tick_bars(ticks, "1 hour", "10 minutes")
    return run_to_end(spark, bars).select("epic", "begin_ts", "o", "h", "l", "c", "volume")


@query(
    "t4_landed_once",
    f"SELECT event_id, event_type AS epic, epoch_us(ts) AS ts, {r('value')} AS value FROM events",
)
def _(spark, d):
    """Every event delivered twice and landed once."""
    twice = event_stream(spark, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    once = S.unique_rows(twice, "event_id", "ts", "1 hour")

    def land(rows, path, checkpoint, once):
        return S.land(rows, path, checkpoint, "ts", once, ["event_id"])

    landed = run_to_end(spark, once, land)
    return landed.select("event_id", F.col("event_type").alias("epic"), "ts", "value")


@query(
    "t5_live_indicators",
    I.with_sql(
        "bars AS (SELECT CAST(user_id AS VARCHAR) AS epic, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, "
        "event_id, value AS o, value AS h, value AS l, value AS c FROM events)",
        I.sql_recurrences(),
        f"SELECT epic, event_id AS tie, {r('ema')} AS ema, {r('rsi')} AS rsi, {r('atr')} AS atr FROM smooth",
    ),
)
def _(spark, d):
    """EMA, RSI and ATR carried along every user's live series."""
    v = F.col("value")
    bars = event_stream(spark, d).select(
        F.col("user_id").cast("string").alias("epic"),
        F.col("ts").alias("end_ts"),
        F.col("event_id").alias("tie"),
        v.alias("h"),
        v.alias("l"),
        v.alias("c"),
    )
    live = live_indicators(bars, I.DEMO.ema_period, I.DEMO.rsi_period, I.DEMO.atr_period)
    return on_time(run_to_end(spark, live)).select("epic", "tie", "ema", "rsi", "atr")
