"""Review annotations: append logs, latest state, merges, and joins by signal key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barworks.operators.bars import index_at_or_after
from barworks.schemas import FLAGS, MARK_KINDS, REQUIRED_TRADE_FIELDS


def latest(log: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """Last write per key from an append log; keys whose last write is a deletion are gone.

    ``max`` over one struct combines map-side, so a key written very often costs one row per map
    task and never a sorted group.
    """
    rest = [c for c in log.columns if c not in {*keys, *order}]
    row = F.struct(*order, *rest)
    last = log.groupBy(*keys).agg(F.max(row).alias("_row"))
    out = last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]])
    if deleted is not None:
        out = out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
    return out


def latest_feedback(log: DataFrame) -> DataFrame:
    """One verdict per signal key: (signal_key, flag, note, created_at, id)."""
    return latest(log, ["signal_key"], ["created_at", "id"])


def latest_marks(log: DataFrame) -> DataFrame:
    """One mark per (signal key, kind); tombstone rows have ``deleted`` set."""
    return latest(log, ["signal_key", "kind"], ["created_at", "id"], deleted="deleted")


def merge_marks(base: DataFrame, overrides: DataFrame, keys: tuple[str, ...] = ("signal_key", "kind")) -> DataFrame:
    """Override rows win per key; base rows of other keys stay."""
    kept = base.join(overrides.select(*keys), list(keys), "left_anti")
    return kept.unionByName(overrides)


def attach(trades: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations joined to the trades of any run by signal key."""
    return trades.join(annotations, "signal_key", "left")


def unreviewed(trades: DataFrame, annotations: DataFrame) -> DataFrame:
    return trades.join(annotations.select("signal_key"), "signal_key", "left_anti")


def orphans(annotations: DataFrame, trades: DataFrame) -> DataFrame:
    """Annotations whose signal no run has."""
    return annotations.join(trades.select("signal_key"), "signal_key", "left_anti")


def mark_outcomes(marks: DataFrame, trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Where a mark lies relative to entry and exit, and the pnl had the exit been there."""
    placed = index_at_or_after(marks.join(trades, "signal_key"), bars, "bar_ts", "mark_idx")
    at_mark = bars.select("epic", F.col("idx").alias("mark_idx"), F.col("c").alias("mark_price"))
    sign = F.when(F.col("direction") == "LONG", F.lit(1.0)).otherwise(F.lit(-1.0))
    return placed.join(at_mark, ["epic", "mark_idx"]).withColumns(
        {
            "bars_from_entry": F.col("mark_idx") - F.col("entry_idx"),
            "bars_to_exit": F.col("exit_idx") - F.col("mark_idx"),
            "pnl_at_mark": sign * (F.col("mark_price") - F.col("entry_price")),
        }
    )


def missing_fields(fields: tuple[str, ...] = REQUIRED_TRADE_FIELDS) -> Column:
    named = F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in fields])
    return F.filter(named, lambda x: x.isNotNull())


def split_complete(
    trades: DataFrame, fields: tuple[str, ...] = REQUIRED_TRADE_FIELDS
) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``missing_fields``)."""
    checked = trades.withColumn("missing_fields", missing_fields(fields))
    good = checked.where(F.size("missing_fields") == 0).drop("missing_fields")
    return good, checked.where(F.size("missing_fields") > 0)


def known_flag(flag: Column) -> Column:
    """A flag may be absent; one that is given must be of the vocabulary."""
    return flag.isNull() | flag.isin(*FLAGS)


def known_kind(kind: Column) -> Column:
    return F.coalesce(kind.isin(*MARK_KINDS), F.lit(False))


def split_vocabulary(rows: DataFrame, known: Column) -> tuple[DataFrame, DataFrame]:
    return rows.where(known), rows.where(~known)
