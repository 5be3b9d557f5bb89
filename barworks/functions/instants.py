"""Expressions on UTC instants (``TimestampType``, session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def epoch_whole_s(ts: Column) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.unix_seconds(ts)


def iso_instant(ts: Column) -> Column:
    """ISO-8601 text with ``Z``; the fraction is dropped when zero, else 3 or 6 digits."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(F.pmod(micros, F.lit(1000)) == 0, F.date_format(ts, ".SSS"))
        .otherwise(F.date_format(ts, ".SSSSSS"))
    )
    return F.concat(whole, fraction, F.lit("Z"))


def iso_weekday(ts: Column) -> Column:
    """Monday = 1 … Sunday = 7."""
    return (F.weekday(ts) + F.lit(1)).cast("int")


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
