"""Fixed schemas. Readers refuse inputs that lack a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRICE_COLUMNS = [
    f"{leg}_{side}" for leg in ("open", "high", "low", "close") for side in ("bid", "ask")
]

QUOTE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("epic", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("snapshot_time_utc", T.TimestampType()),
        *[T.StructField(name, T.DoubleType(), False) for name in PRICE_COLUMNS],
        T.StructField("last_traded_volume", T.LongType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("ingestion_time_utc", T.TimestampType()),
    ]
)

_PRICE = T.StructType(
    [
        T.StructField("bid", T.DecimalType(18, 6)),
        T.StructField("ask", T.DecimalType(18, 6)),
        T.StructField("lastTraded", T.DecimalType(18, 6)),
    ]
)

# Nested reply of the broker's price history call, with the request's epic and resolution.
PRICE_REPLY = T.StructType(
    [
        T.StructField("epic", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField(
            "prices",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("snapshotTime", T.StringType()),
                        T.StructField("snapshotTimeUTC", T.StringType()),
                        T.StructField("openPrice", _PRICE),
                        T.StructField("closePrice", _PRICE),
                        T.StructField("highPrice", _PRICE),
                        T.StructField("lowPrice", _PRICE),
                        T.StructField("lastTradedVolume", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("instrumentType", T.StringType()),
    ]
)

STREAM_MESSAGE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("destination", T.StringType()),
        T.StructField("correlationId", T.StringType()),
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("epic", T.StringType()),
                    T.StructField("product", T.StringType()),
                    T.StructField("bid", T.DoubleType()),
                    T.StructField("bidQty", T.DoubleType()),
                    T.StructField("ofr", T.DoubleType()),
                    T.StructField("ofrQty", T.DoubleType()),
                    T.StructField("timestamp", T.LongType()),
                ]
            ),
        ),
    ]
)

# The closed review vocabularies.
FLAGS = ("knife-catch", "chop", "news-spike", "late-entry", "bad-exit", "good-signal")
MARK_KINDS = ("better-entry", "T1", "T2", "T3", "exit-here")
# A trade row without one of these is broken.
REQUIRED_TRADE_FIELDS = (
    "entry_time",
    "exit_time",
    "direction",
    "entry_price",
    "exit_price",
    "stop_price",
    "target_price",
    "pnl",
    "net_pnl",
    "r_multiple",
    "is_win",
)
# Features a slice may be asked for, which are those stored with a trade.
SLICE_FEATURES = (
    "rsi_value",
    "dist_to_bb_lower_atr",
    "dist_to_bb_upper_atr",
    "dist_to_support_atr",
    "dist_to_resistance_atr",
    "dist_to_trend_ema_atr",
    "trend_slope_atr",
    "atr_value",
    "atr_percentile",
    "volume_ratio",
    "hour_utc",
    "day_of_week",
    "r_multiple",
    "confluence_score",
)


def require(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
