"""Sharding by a Hilbert curve over document metadata, in DataFrame functions only.

Language, source and size are quantised to a few bits each. The place of a document on the Hilbert
curve through that grid orders the documents, so a run of the order is a compact region in every
dimension and files cut from it can be skipped by any of them. Runs are cut by rank: shards differ
by one row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barworks.llm.arrow import prepared

BITS = 5  # per dimension: 32 steps, 32,768 cells


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point whose coordinates are integers of ``bits`` bits.

    The coordinates are turned, from the highest bit down, into the reflected and rotated frame of
    the sub-cube they lie in; their bits interleaved are then the Gray code of the index. Each level
    is one step over an array, so the expression does not grow with the number of levels.
    """
    n = len(axes)

    def level(x: Column, q: Column) -> Column:
        low = q - 1
        for i in range(n):
            first, mine = x[0], x[i]
            swap = (first.bitwiseXOR(mine)).bitwiseAND(low)
            set_here = mine.bitwiseAND(q) != 0
            if i == 0:
                parts = [F.when(set_here, first.bitwiseXOR(low)).otherwise(first), *[x[k] for k in range(1, n)]]
            else:
                parts = [
                    F.when(set_here, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap)),
                    *[F.when(set_here, mine).otherwise(mine.bitwiseXOR(swap)) if k == i else x[k] for k in range(1, n)],
                ]
            x = F.transform(F.array(F.array(*parts)), lambda v: v)[0]
        return x

    start = F.array(*[a.cast("int") for a in axes])
    halves = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    turned = F.aggregate(halves, start, level)

    def interleaved(x: Column) -> Column:
        gray = F.lit(0)
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                gray = F.shiftleft(gray, 1).bitwiseOR(F.shiftright(x[i], b).bitwiseAND(F.lit(1)))
        return gray

    code = F.transform(F.array(turned), interleaved)[0]

    def folded(by: int):
        return lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, by))

    def from_gray(g: Column) -> Column:
        shift = 1
        while shift < n * bits:
            g = F.transform(F.array(g), folded(shift))[0]
            shift *= 2
        return g

    return from_gray(code)


def cell(lang: Column, source: Column, size: Column) -> Column:
    """Place of a document on the curve; equal values of a dimension share a step of it."""
    steps = 1 << BITS
    named = lambda c: F.pmod(F.xxhash64(c), F.lit(steps))
    scale = F.least(F.floor(F.log2(size.cast("double")) * 1.5), F.lit(steps - 1))
    return hilbert_index([named(lang), named(source), scale], BITS)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert) per document.

    ``size`` is the UTF-8 length of the text plus one, null texts counting as empty. The law is
    ``rows``: shard s of n takes ranks floor(s * total / n) up to the next, so counts differ by one
    at most; ``slot`` is the place in the shard, from 0 without gaps; ``grown_shard`` is null. Ranks
    follow the Hilbert index, then the CRC of the text, which keeps equal texts near each other,
    then doc_id. Null languages and sources are values of their own; rows equal in all these are
    interchangeable. Each cell of the curve is numbered in chunks, so neither a frequent cell nor a
    frequent text is ranked in one task. An empty table gives an empty result; other columns are
    ignored.
    """
    prepared(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source",
    )
    facts = facts.select("doc_id", "size", "text_crc32", cell(F.col("lang"), F.col("source"), F.col("size")).alias("hilbert"))
    # 64 chunks by CRC and in each of them 64 by id.
    chunk = F.shiftright("text_crc32", 26) * 64 + F.pmod(F.xxhash64("doc_id"), F.lit(64))
    facts = facts.withColumn("_chunk", chunk.cast("int"))
    counts = facts.groupBy("hilbert", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    # The one window without a key runs over the cells of the curve, 32,768 at most.
    cells = counts.groupBy("hilbert").agg(F.sum("_n").alias("_cell"))
    earlier = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "hilbert", F.coalesce(F.sum("_cell").over(earlier), F.lit(0)).alias("_from"), F.sum("_cell").over(Window.partitionBy()).alias("_total")
    )
    inside = Window.partitionBy("hilbert").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(cells, "hilbert")
    starts = starts.select("hilbert", "_chunk", (F.col("_from") + F.col("_before")).alias("_start"), "_total")
    local = F.row_number().over(Window.partitionBy("hilbert", "_chunk").orderBy("text_crc32", "doc_id")) - 1
    ranked = facts.join(starts.hint("merge"), ["hilbert", "_chunk"]).withColumn("_rank", F.col("_start") + local)
    # Largest s with floor(s * total / n) <= rank.
    place = F.floor(((F.col("_rank") + 1) * shards - 1) / F.col("_total")).cast("int")
    first = F.floor(F.col("shard").cast("long") * F.col("_total") / shards).cast("long")
    return ranked.withColumn("shard", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the documents into one folder per shard, each ordered along the curve.

    Needs unique doc_ids: places are joined back by them.
    """
    places = shard(docs, shards).select("doc_id", "shard", "slot")
    rows = docs.join(places, "doc_id").repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
