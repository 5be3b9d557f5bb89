"""Live quote messages: parsing, subscriptions, tick bars, and landing."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barworks.schemas import STREAM_MESSAGE
from barworks.session import files_of


@dataclass(frozen=True)
class Subscription:
    """Instruments, resolutions and bar types to keep. Blank entries are refused."""

    epics: tuple[str, ...]
    resolutions: tuple[str, ...]
    types: tuple[str, ...] = ()

    def __post_init__(self):
        for field in ("epics", "resolutions"):
            values = getattr(self, field)
            if not values:
                raise ValueError(f"{field} must not be empty")
            if any(v is None or not v.strip() for v in values):
                raise ValueError(f"{field} must not hold blanks")


def parse_messages(raw: DataFrame, destination: str, value: str = "value") -> DataFrame:
    """JSON envelopes → payload rows of OK messages for one destination; pings fall away."""
    message = F.from_json(F.col(value).cast("string"), STREAM_MESSAGE)
    wanted = (F.col("m.status") == "OK") & (F.col("m.destination") == destination)
    return (
        raw.select(message.alias("m"))
        .where(wanted & (F.col("m.destination") != "ping"))
        .select(
            F.col("m.correlationId").alias("correlation_id"),
            F.col("m.payload.epic").alias("epic"),
            F.col("m.payload.product").alias("product"),
            F.col("m.payload.bid").alias("bid"),
            F.col("m.payload.bidQty").alias("bid_qty"),
            F.col("m.payload.ofr").alias("ofr"),
            F.col("m.payload.ofrQty").alias("ofr_qty"),
            F.timestamp_millis(F.col("m.payload.timestamp")).alias("ts"),
        )
    )


def subscribed(rows: DataFrame, subscription: Subscription) -> DataFrame:
    """Rows of the subscribed instruments, and of the subscribed resolutions and types if present."""
    kept = rows.where(F.col("epic").isin(*subscription.epics))
    if "resolution" in rows.columns:
        kept = kept.where(F.col("resolution").isin(*subscription.resolutions))
    if "type" in rows.columns and subscription.types:
        kept = kept.where(F.col("type").isin(*subscription.types))
    return kept


def subscribed_from_table(rows: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The same filter from a table (epic, resolution, type): a row is kept if some subscription
    names its instrument, and its resolution and type where the row has them. A null resolution or
    type of a subscription stands for all."""
    sides = [c for c in ("resolution", "type") if c in rows.columns and c in subscriptions.columns]
    wanted = subscriptions.select(F.col("epic").alias("_epic"), *[F.col(c).alias(f"_{c}") for c in sides]).distinct()
    match = F.col("epic") == F.col("_epic")
    for c in sides:
        match = match & (F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")))
    return rows.join(wanted, match, "left_semi")


def live_subscription(path: str) -> Callable[[DataFrame], DataFrame]:
    """A filter of micro-batches by the subscriptions that the table at ``path`` has at that time.

    A static side of a streaming join keeps the files it began with; here each batch lists them anew,
    so a subscription added between two batches counts from the next one on.
    """
    return lambda batch: subscribed_from_table(batch, batch.sparkSession.read.parquet(path))


def tick_bars(ticks: DataFrame, width: str, lateness: str, tie: str = "correlation_id") -> DataFrame:
    """Ticks → mid-price bars over tumbling windows; a bar comes out once its window is closed."""
    order = F.struct("ts", F.col(tie))
    mid = (F.col("bid") + F.col("ofr")) / 2
    bars = (
        ticks.withWatermark("ts", lateness)
        .withColumn("mid", mid)
        .groupBy("epic", F.window("ts", width))
        .agg(
            F.min_by("mid", order).alias("o"),
            F.max("mid").alias("h"),
            F.min("mid").alias("l"),
            F.max_by("mid", order).alias("c"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )
    return bars.select(
        "epic",
        F.col("window.start").alias("begin_ts"),
        F.col("window.end").alias("end_ts"),
        "o",
        "h",
        "l",
        "c",
        "volume",
    )


def unique_rows(rows: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """Drop repeated deliveries of a key; state is kept only as long as repeats may arrive."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gave its stream; a new checkpoint is a new stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _landed_by_others(spark: SparkSession, path: str, batch: DataFrame, stream: str, number: int) -> DataFrame | None:
    """Rows of the ledger that another batch of this or another stream has landed."""
    schema = T.StructType([*batch.schema.fields, T.StructField("stream_id", T.StringType()), T.StructField("batch_id", T.LongType())])
    files, where = files_of(spark, path)
    if not files.exists(where):
        return None
    return spark.read.schema(schema).parquet(path).where((F.col("stream_id") != stream) | (F.col("batch_id") != number))


def land(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    ts: str,
    once: bool = False,
    key: list[str] | None = None,
    change: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Land a stream exactly once in a ledger of (stream, batch).

    Each micro-batch replaces its own folder, so a replay after a failure leaves the same rows. The
    stream is that of the checkpoint: a lost or second checkpoint begins again at batch 0 of a new
    stream and overwrites nothing. Rows whose ``key`` (by default the whole row) was landed before,
    by any stream, are left out, so a source that is read again is still landed once. They are
    looked for among the rows of their own date. ``change`` is applied to every micro-batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = _stream_id(spark, checkpoint)
        new = (change(batch) if change else batch).withColumn("date", F.to_date(ts))
        known = _landed_by_others(spark, path, new, stream, number)
        if known is not None:
            same = [new[c].eqNullSafe(known[c]) for c in dict.fromkeys(["date", *(key or new.columns)])]
            new = new.join(known, same, "left_anti")
        new.write.mode("overwrite").partitionBy("date").parquet(f"{path}/stream_id={stream}/batch_id={number}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def to_table(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append closed rows to a Parquet table."""
    writer = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
