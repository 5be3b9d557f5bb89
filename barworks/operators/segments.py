"""Bounded windows and recurrences over long bar series.

A series is cut into segments of ``size`` bars; each segment also carries the first bars of the
next one as a tail, so every backward frame of up to ``lookback`` bars lies inside one segment.
All window work then partitions by (series, segment): a long series is spread over many tasks, and
one shuffle serves every indicator.

A recurrence ``y[t] = d*y[t-1] + (1-d)*x[t]`` reaches back without limit. Inside a segment it is
``y[k] = d**k * (y[0] + sum((1-d)*x[j]*d**-j))``, a running sum. The value at each segment start
comes from one summary row per segment (a plain aggregate of the segment before), folded over the
preceding segments until the weight is below half a unit in the last place of a double.

Where ``d`` fades so fast that its powers over a segment leave the range of a double, the running sum
starts anew in blocks of the segment, and a block takes over the end of the one before: what lies
further back has faded to nothing. The segment size follows the frames alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 2048
MAX_EXPONENT = 600.0  # keeps d**-k inside the range of a double
# exp(-745) is below the least double. Ratios of two fading columns need the whole range: a carry
# cut where it no longer shows in a sum would turn an RSI on a flat stretch into zero.
FORGET_EXPONENT = 745.0


@dataclass(frozen=True)
class Recurrence:
    """A smoothed column: ``alpha`` is the weight of the new value."""

    name: str
    source: str
    alpha: float

    @property
    def decay(self) -> float:
        return 1.0 - self.alpha


def ema_alpha(period: int) -> float:
    return 2.0 / (period + 1)


def wilder_alpha(period: int) -> float:
    return 1.0 / period


def segment_size(lookback: int, size: int = SEGMENT) -> int:
    """``size``, or what the longest frame needs."""
    return max(size, lookback + 2)


def block_size(r: Recurrence) -> int:
    """Bars over which the powers of a decay, centred, stay inside the range of a double."""
    return max(1, int(2 * MAX_EXPONENT / -math.log(r.decay)))


@dataclass(frozen=True)
class Segmented:
    """Bars spread over overlapping segments; ``frame`` has ``_seg`` and ``_pos``."""

    frame: DataFrame
    keys: tuple[str, ...]
    size: int
    lookback: int

    @property
    def ordered(self):
        return Window.partitionBy(*self.keys, "_seg").orderBy("_pos")

    def last(self, n: int):
        """Frame of the last ``n`` bars, the current one included."""
        if n > self.lookback + 1:
            raise ValueError("frame is longer than the lookback")
        return self.ordered.rowsBetween(-(n - 1), 0)

    def with_frame(self, frame: DataFrame) -> "Segmented":
        return Segmented(frame, self.keys, self.size, self.lookback)

    def own_rows(self) -> DataFrame:
        """Each bar once, from the segment where its whole lookback is present."""
        pos, tail = F.col("_pos"), self.size + self.lookback
        own = (pos <= tail) & ((F.col("_seg") == 0) | (pos > self.lookback))
        return self.frame.where(own).drop("_seg", "_pos")


def cut(bars: DataFrame, keys: tuple[str, ...], lookback: int, size: int) -> Segmented:
    """Spread bars over segments. The tail is one bar longer than the lookback, for ``lead``."""
    seg = F.floor(F.col("idx") / size).cast("long")
    pos = (F.col("idx") % size).cast("long")
    home = F.struct(seg.alias("s"), pos.alias("p"))
    tail = F.struct((seg - 1).alias("s"), (pos + size).alias("p"))
    copies = F.when((pos <= lookback + 1) & (seg > 0), F.array(home, tail)).otherwise(F.array(home))
    spread = (
        bars.withColumn("_copy", F.explode(copies))
        .withColumn("_seg", F.col("_copy.s"))
        .withColumn("_pos", F.col("_copy.p"))
        .drop("_copy")
    )
    return Segmented(spread, keys, size, lookback)


def _scaled(r: Recurrence, exponent: Column) -> Column:
    return F.pow(F.lit(r.decay), exponent)


def _fold(past: Column, step: Column) -> Column:
    """Oldest to newest: what each segment added, faded by one segment per step."""
    return F.aggregate(past, F.lit(0.0), lambda acc, x: acc * step + x)


def smooth(parts: Segmented, recurrences: list[Recurrence]) -> Segmented:
    """Add every recurrence as a column. The source column must be right from ``_pos`` 1 on."""
    if not recurrences:
        return parts
    frame, size = parts.frame, parts.size
    pos = F.col("_pos")
    first = (F.col("_seg") == 0) & (pos == 0)
    live = [r for r in recurrences if 0.0 < r.decay < 1.0]
    grain = [*parts.keys, "_seg"]

    ends = frame.where((pos <= size) & ((F.col("_seg") == 0) | (pos > 0)))
    sums = ends.groupBy(*grain).agg(
        (F.max("_pos") == size).alias("_full"),
        *[
            F.sum(
                F.when(pos > 0, F.col(r.source) * r.alpha * _scaled(r, F.lit(size) - pos))
            ).alias(f"_end_{r.name}")
            for r in live
        ],
        *[F.max(F.when(first, F.col(r.source))).alias(f"_init_{r.name}") for r in live],
    )
    # Row per target segment: what the segment before adds, or the first value for segment 0.
    added = sums.select(
        *parts.keys,
        F.explode(
            F.filter(
                F.array(
                    F.when(
                        F.col("_full"),
                        F.struct(
                            (F.col("_seg") + 1).alias("s"),
                            *[F.col(f"_end_{r.name}").alias(r.name) for r in live],
                        ),
                    ),
                    F.when(
                        F.col("_seg") == 0,
                        F.struct(
                            F.lit(0).cast("long").alias("s"),
                            *[F.col(f"_init_{r.name}").alias(r.name) for r in live],
                        ),
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("_add"),
    ).select(*parts.keys, F.col("_add.s").alias("_seg"), *[F.col(f"_add.{r.name}") for r in live])

    series = Window.partitionBy(*parts.keys).orderBy("_seg")
    carries = []
    for r in live:
        step = F.lit(r.decay**size)
        reach = math.ceil(FORGET_EXPONENT / (-math.log(r.decay) * size))
        past = F.collect_list(r.name).over(series.rowsBetween(-reach, 0))
        carries.append(_fold(past, step).alias(f"_carry_{r.name}"))
    carried = added.select(*grain, *carries)

    joined = frame.join(carried, grain, "left")
    longest = size + parts.lookback + 2
    local, ends_before = {}, {}
    for r in live:
        block = block_size(r)
        spread = Window.partitionBy(*grain) if block >= longest else Window.partitionBy(*grain, F.floor(pos / block))
        upto = spread.orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        centre = block // 2 if block < longest else longest // 2
        inside = pos if block >= longest else pos % block
        part = F.when(pos > 0, F.col(r.source) * r.alpha * _scaled(r, centre - inside)).otherwise(F.lit(0.0))
        local[f"_sum_{r.name}"] = _scaled(r, inside - centre) * F.sum(part).over(upto)
        if block < longest:
            end = F.when(inside == block - 1, F.col(f"_sum_{r.name}"))
            earlier = parts.ordered.rowsBetween(Window.unboundedPreceding, -1)
            ends_before[f"_end_{r.name}"] = _scaled(r, inside + 1) * F.coalesce(F.last(end, ignorenulls=True).over(earlier), F.lit(0.0))
    joined = joined.withColumns(local)
    if ends_before:
        joined = joined.withColumns(ends_before)
    values = {}
    for r in recurrences:
        if r in live:
            before = F.col(f"_end_{r.name}") if f"_end_{r.name}" in ends_before else F.lit(0.0)
            values[r.name] = _scaled(r, pos) * F.col(f"_carry_{r.name}") + (F.col(f"_sum_{r.name}") + before)
        else:
            values[r.name] = F.col(r.source)
    joined = joined.withColumns(values).drop(
        *[f"_carry_{r.name}" for r in live], *[f"_sum_{r.name}" for r in live], *ends_before
    )
    return parts.with_frame(joined)
