"""Quotes to bars, bar positions, and lookups around a position or an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barworks.functions.instants import epoch_whole_s
from barworks.operators.ordered import join_per_key, number_rows
from barworks.schemas import PRICE_COLUMNS, require
from barworks.session import materialize

SOURCE_BAR_SECONDS = 60
BLOCK = 256  # bars per lookup block


def mid_prices(quotes: DataFrame) -> DataFrame:
    """Bid/ask legs → mid open, high, low, close."""
    require(quotes, PRICE_COLUMNS)
    mids = {
        short: ((F.col(f"{leg}_bid") + F.col(f"{leg}_ask")) / 2).alias(short)
        for short, leg in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))
    }
    kept = [name for name in quotes.columns if name not in PRICE_COLUMNS]
    return quotes.select(*kept, *mids.values())


def _bucket_start(end_ts: Column, minutes: int) -> Column:
    """Start second of the bucket a source bar belongs to; its time stamp is its end."""
    begin = F.unix_micros(end_ts) - F.lit(SOURCE_BAR_SECONDS * 1_000_000)
    return F.floor(begin / F.lit(minutes * 60_000_000)) * F.lit(minutes * 60)


def resample(
    quotes: DataFrame, minutes: int, keep_open_bucket: bool = False, tie: str | None = None
) -> DataFrame:
    """One-minute quotes → n-minute bars with a dense index per instrument.

    A quote table has one quote per instrument and instant; name ``tie`` to order the quotes of a
    raw feed that repeats instants (the order then needs a sort instead of a hash aggregate).
    The quotes are reduced map-side to one row per (epic, bucket) before the shuffle. A bucket
    that the source has not yet passed is dropped: that can only be the last one, so the index of
    the others is not affected. Both the bucket check and the index offsets come from one small
    (epic, day) table built from two quote columns.
    """
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    ts = F.col("snapshot_time_utc")
    bucket = _bucket_start(ts, minutes)
    day = F.floor(F.col("_bucket") / 86_400)
    order = F.struct("snapshot_time_utc", tie) if tie else F.col("snapshot_time_utc")
    bars = (
        mid_prices(quotes)
        .groupBy("epic", bucket.alias("_bucket"))
        .agg(
            F.min_by("o", order).alias("o"),
            F.max("h").alias("h"),
            F.min("l").alias("l"),
            F.max_by("c", order).alias("c"),
            F.sum("last_traded_volume").cast("double").alias("volume"),
        )
        .withColumn("_day", day)
    )
    days = (
        quotes.groupBy("epic", bucket.alias("_bucket"))
        .agg(F.max("snapshot_time_utc").alias("_last"))
        .groupBy("epic", day.alias("_day"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_last").alias("_last"))
    )
    series = Window.partitionBy("epic")
    before = series.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(
        "epic",
        "_day",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.max("_last").over(series).alias("_series_last"),
    )
    local = F.row_number().over(Window.partitionBy("epic", "_day").orderBy("_bucket")) - 1
    placed = bars.join(days, ["epic", "_day"]).select(
        "epic",
        F.lit(minutes).alias("tf_min"),
        (F.col("_off") + local).cast("long").alias("idx"),
        F.timestamp_seconds("_bucket").alias("begin_ts"),
        F.timestamp_seconds(F.col("_bucket") + minutes * 60).alias("end_ts"),
        "o",
        "h",
        "l",
        "c",
        "volume",
        "_series_last",
    )
    if not keep_open_bucket:
        placed = placed.where(F.col("end_ts") <= F.col("_series_last"))
    return placed.drop("_series_last")


def rows_as_bars(df: DataFrame, epic: Column, ts: str, price: str, tie: str) -> DataFrame:
    """Treat each row of a table as one flat bar of the series ``epic``."""
    flat = df.select(
        epic.alias("epic"),
        F.col(ts).cast("timestamp").alias("end_ts"),
        F.col(tie).alias("_tie"),
        *[F.col(price).alias(leg) for leg in ("o", "h", "l", "c")],
    )
    return number_rows(flat, ["epic"], ["end_ts", "_tie"], [F.to_date("end_ts")]).drop("_tie")


def average_spread(quotes: DataFrame, keys: tuple[str, ...] = ("epic",)) -> DataFrame:
    return quotes.groupBy(*keys).agg(F.avg(F.col("close_ask") - F.col("close_bid")).alias("avg_spread"))


def trading_days(bars: DataFrame) -> DataFrame:
    """Distinct UTC dates of bar ends per instrument, counted in two combinable steps."""
    return (
        bars.select("epic", F.to_date("end_ts").alias("_d"))
        .distinct()
        .groupBy("epic")
        .agg(F.count(F.lit(1)).alias("trading_days"))
    )


TOP_STEPS = 20  # a series may have so many doublings of groups


def _first_end(then: Column, steps: int) -> Column:
    """The first packed item that ends at or after the instant of an event, found by halving."""
    halves = F.array(*[F.lit(1 << k) for k in range(steps, -1, -1)])
    earlier = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get("_items", at + half - 1)["end_ts"] < F.col("_at"), at + half).otherwise(at))
    return F.coalesce(F.get("_items", F.when(F.col("_at").isNotNull(), earlier))["at"], then)


def _pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "end_ts"))).alias("_items"))


def index_at_or_after(events: DataFrame, bars: DataFrame, at: str, name: str = "bar_idx") -> DataFrame:
    """Forward as-of: index of the first bar whose end is at or after ``at``, else the last bar.

    Ends never decrease along ``idx``, so a search descends like in a tree: bars are packed in blocks
    of 256, blocks in groups of 256, groups in one row per series, each with the last end of what is
    below. An event meets one row a level by an equality join, however many bars a day or an instant
    has and however long a gap is. An event without instant gets the last bar, one of an unknown
    series null.
    """
    blocks = materialize(_pack(bars.select("epic", F.expr(f"idx div {BLOCK}").alias("_blk"), F.col("idx").alias("at"), "end_ts"), ["epic", "_blk"]))
    last = F.element_at("_items", -1)["end_ts"].alias("end_ts")
    groups = _pack(blocks.select("epic", F.expr(f"_blk div {BLOCK}").alias("_grp"), F.col("_blk").alias("at"), last), ["epic", "_grp"])
    top = _pack(groups.select("epic", F.col("_grp").alias("at"), last), ["epic"])
    ends = blocks.groupBy("epic").agg(F.max_by(F.element_at("_items", -1)["at"], "_blk").alias("_last_idx"))
    steps = BLOCK.bit_length() - 1
    # An event past the end has no group: it gets keys that match nothing and lie in many tasks.
    plain = [c for c, kind in events.dtypes if "map<" not in kind]
    nowhere = -1 - F.pmod(F.xxhash64(*plain), F.lit(9973))
    work = join_per_key(events.withColumns({"_at": F.col(at), "_no": nowhere}), top.join(ends, "epic"), ["epic"], "left")
    work = work.withColumn("_grp", _first_end(F.col("_no"), TOP_STEPS)).drop("_items")
    work = work.join(groups, ["epic", "_grp"], "left").withColumn("_blk", _first_end(F.col("_no"), steps)).drop("_items")
    work = work.join(blocks, ["epic", "_blk"], "left").withColumn(name, _first_end(F.col("_last_idx"), steps)).drop("_items")
    return work.drop("_at", "_no", "_grp", "_blk", "_last_idx")


def bar_window(
    spans: DataFrame, bars: DataFrame, key: str | list[str], before: int = 50, after: int = 50
) -> DataFrame:
    """Bars from ``before`` bars ahead of ``entry_idx`` to ``after`` bars past ``exit_idx``.

    Returns ``key`` (a column or several) with a time-ordered ``bars`` array; it must tell the spans
    of an instrument apart. Bars are packed in blocks of 256 and a span is spread over the few
    blocks it covers, so this is an equi-join, not a range join.
    """
    keys = [key] if isinstance(key, str) else key
    lo = F.greatest(F.lit(0), F.least("entry_idx", "exit_idx") - before)
    hi = F.greatest("entry_idx", "exit_idx") + after
    wanted = spans.select("epic", *keys, lo.alias("_lo"), hi.alias("_hi")).withColumn(
        "_blk",
        F.explode(F.sequence(F.floor(F.col("_lo") / BLOCK), F.floor(F.col("_hi") / BLOCK))),
    )
    blocks = bars.groupBy("epic", F.floor(F.col("idx") / BLOCK).alias("_blk")).agg(
        F.sort_array(
            F.collect_list(F.struct("idx", epoch_whole_s(F.col("end_ts")).alias("t"), "o", "h", "l", "c"))
        ).alias("_bars")
    )
    inside = F.filter("_bars", lambda b: (b["idx"] >= F.col("_lo")) & (b["idx"] <= F.col("_hi")))
    return (
        wanted.join(blocks, ["epic", "_blk"])
        .groupBy("epic", *keys)
        .agg(F.flatten(F.sort_array(F.collect_list(inside))).alias("bars"))
    )


def price_range(bars: Column, extras: list[Column] | None = None) -> dict[str, Column]:
    """Lowest and highest price of a bar array and extra levels, padded by 2% (by 1 when flat)."""
    extra = F.array(*extras) if extras else F.array().cast("array<double>")
    lo = F.array_min(F.concat(F.transform(bars, lambda b: b["l"]), extra))
    hi = F.array_max(F.concat(F.transform(bars, lambda b: b["h"]), extra))
    pad = F.when(hi > lo, (hi - lo) * 0.02).otherwise(F.lit(1.0))
    return {"range_min": lo - pad, "range_max": hi + pad}


def visible_range(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Time span of the trades per group, padded by a quarter of it and at least half an hour."""
    entry, exit_ = epoch_whole_s(F.col("entry_ts")), epoch_whole_s(F.col("exit_ts"))
    spans = trades.groupBy(*keys).agg(
        F.min(F.least(entry, exit_)).alias("_from"), F.max(F.greatest(entry, exit_)).alias("_to")
    )
    pad = F.greatest(F.lit(1800).cast("long"), F.floor((F.col("_to") - F.col("_from")) / 4))
    return spans.select(
        *keys, (F.col("_from") - pad).alias("visible_from"), (F.col("_to") + pad).alias("visible_to")
    )
