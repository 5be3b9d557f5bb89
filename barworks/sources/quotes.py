"""Quote sources: the stored quote table, nested price replies, and the given event table."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barworks.schemas import PRICE_COLUMNS, PRICE_REPLY, QUOTE, require


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """The stored quote table (Parquet partitioned by date)."""
    return require(spark.read.parquet(path), QUOTE.fieldNames())


def write_quotes(quotes: DataFrame, path: str) -> None:
    """Land quotes partitioned by day, clustered by epic inside each file.

    The day bounds a partition whatever the mix of instruments; a partition column per instrument
    and day would make one tiny file per pair. Landing an instrument's day again replaces it; other
    instruments of that day, already stored, are written again beside it.
    """
    rows = require(quotes, ["epic", "snapshot_time_utc"]).withColumn("date", F.to_date("snapshot_time_utc"))
    (
        _with_stored_neighbours(rows, path)
        .repartitionByRange("date", "epic", "snapshot_time_utc")
        .sortWithinPartitions("date", "epic", "snapshot_time_utc")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def _with_stored_neighbours(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` and the stored rows of the same days that belong to other instruments."""
    try:
        stored = rows.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return rows
        raise
    # One value per day of the load, so only the partitions of those days are read.
    days = [r["date"] for r in rows.select("date").where("date IS NOT NULL").distinct().collect()]
    touched = stored.where(F.col("date").isin(days))
    others = touched.join(rows.select("epic", "date").distinct(), ["epic", "date"], "left_anti")
    return rows.unionByName(others, allowMissingColumns=True)


def first_quotes(quotes: DataFrame, epic: str, limit: int) -> DataFrame:
    """The first ``limit`` quotes of one instrument in time order (a top-k, not a full sort)."""
    order = ["snapshot_time_utc", *(["id"] if "id" in quotes.columns else [])]
    return quotes.where(F.col("epic") == epic).orderBy(*order).limit(limit)


def quotes_between(
    quotes: DataFrame, epic: str, start: datetime | str, end: datetime | str, closed: str = "left"
) -> DataFrame:
    """Quotes of one instrument in a time window.

    The default window is half open so that adjoining windows share no row; ``closed="both"``
    includes both ends.
    """
    if closed not in ("left", "both"):
        raise ValueError("closed must be 'left' or 'both'")
    ts = F.col("snapshot_time_utc")
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    upper = ts <= hi if closed == "both" else ts < hi
    window = quotes.where((F.col("epic") == epic) & (ts >= lo) & upper)
    if "date" in quotes.columns:
        window = window.where(F.col("date").between(F.to_date(lo), F.to_date(hi)))
    return window


def check_price_request(
    epic: str | None,
    resolution: str | None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
) -> None:
    """Refuse a price request that cannot be served."""
    if not (epic or "").strip():
        raise ValueError("an epic is needed")
    if not (resolution or "").strip():
        raise ValueError("a resolution is needed")
    if start is not None and end is not None and start >= end:
        raise ValueError("the window must start before it ends")
    if limit is not None and limit <= 0:
        raise ValueError("the row limit must be positive")


def read_price_replies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICE_REPLY).json(path)


def flatten_price_replies(replies: DataFrame, ingested_at: Column, source: str) -> DataFrame:
    """Nested price replies → quote rows, one per (epic, resolution, instant).

    Where replies overlap, the latest ingestion wins. Duplicates are removed by a partial
    aggregation, so repeated downloads shrink before the shuffle.
    """
    item = F.col("item")
    legs = {
        f"{leg}_{side}": item[f"{leg}Price"][side].cast("double")
        for leg in ("open", "high", "low", "close")
        for side in ("bid", "ask")
    }
    rows = (
        replies.withColumn("ingestion_time_utc", ingested_at)
        .select("epic", "resolution", "ingestion_time_utc", F.explode("prices").alias("item"))
        .select(
            "epic",
            "resolution",
            F.to_timestamp(item["snapshotTimeUTC"]).alias("snapshot_time_utc"),
            F.struct(
                "ingestion_time_utc",
                item["lastTradedVolume"].alias("last_traded_volume"),
                *[col.alias(name) for name, col in legs.items()],
            ).alias("row"),
        )
    )
    latest = rows.groupBy("epic", "resolution", "snapshot_time_utc").agg(F.max("row").alias("row"))
    key = F.concat_ws("|", "epic", "resolution", F.unix_micros("snapshot_time_utc").cast("string"))
    return latest.select(
        F.sha2(key, 256).alias("id"),
        "epic",
        "resolution",
        "snapshot_time_utc",
        *[F.col(f"row.{name}").alias(name) for name in PRICE_COLUMNS],
        F.col("row.last_traded_volume").alias("last_traded_volume"),
        F.lit(source).alias("source"),
        F.col("row.ingestion_time_utc").alias("ingestion_time_utc"),
    )


def quotes_from_events(events: DataFrame) -> DataFrame:
    """The given event table read as quotes: a price per event with a small bid/ask spread."""
    half = F.lit(0.01) * (F.lit(1) + F.col("event_id") % 5)
    bid, ask = F.col("value") - half, F.col("value") + half
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("epic"),
        F.col("ts").cast("timestamp").alias("snapshot_time_utc"),
        *[
            (bid if name.endswith("bid") else ask).alias(name)
            for name in PRICE_COLUMNS
        ],
        F.get_json_object("props", "$.k").cast("long").alias("last_traded_volume"),
    )
