"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of a source come in blocks. Time is cut into periods in which source i has as many blocks
as its integer weight, or what is left of it. Inside a period of length D the k-th of m blocks of a
source is released at floor((k - 1) D / m) and due at ceil(k D / m); the earliest deadline goes
first. Every window is met, so at any time a source is less than one block away from its share.
Periods of one shape share one schedule, and a shape changes only where a source runs out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barworks.llm.arrow import prepared
from barworks.session import materialize

BLOCK_DOCS = 16
CHUNK_DIGITS = 3  # hexadecimal; a source is numbered in so many chunks: 4,096
REST = "(rest)"


def period_schedule(amounts: Column) -> Column:
    """Source index of every slot of a period, earliest deadline first; ``amounts`` holds the
    blocks of each source in it. Ties go to the source that comes first."""

    def scheduled(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

        def step(state: Column, t: Column) -> Column:
            due = F.transform(
                a,
                lambda m, i: F.when(
                    (F.get(state["done"], i) < m) & (F.floor(F.get(state["done"], i) * total / m) <= t),
                    F.struct(F.ceil((F.get(state["done"], i) + 1) * total / m).cast("long").alias("at"), i.alias("i")),
                ),
            )
            pick = F.array_min(F.filter(due, lambda d: d.isNotNull()))["i"]
            return F.transform(
                F.array(pick),
                lambda p: F.struct(
                    F.transform(state["done"], lambda n, i: n + F.when(i == p, 1).otherwise(0)).alias("done"),
                    F.concat(state["slots"], F.array(p)).alias("slots"),
                ),
            )[0]

        start = F.struct(
            F.transform(a, lambda m: F.lit(0).cast("long")).alias("done"),
            F.array().cast("array<int>").alias("slots"),
        )
        slots = F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, step, lambda s: s["slots"])
        return F.when(total > 0, slots)

    return F.transform(F.array(amounts), scheduled)[0]


def _plan(blocks: dict[str, int], names: list[str], parts: list[int]) -> Column:
    """Per source its name, weight and number of blocks, as one constant."""
    entries = [F.struct(F.lit(n).alias("s"), F.lit(w).cast("long").alias("w"), F.lit(blocks.get(n, 0)).cast("long").alias("b")) for n, w in zip(names, parts)]
    return F.array(*entries)


def _edges(plan: Column) -> Column:
    """First periods of the shapes: a shape lasts until some source begins to run out, or is out."""
    full = lambda x: F.floor(x["b"] / x["w"]).cast("long")
    return F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0).cast("long")), F.transform(plan, full), F.transform(plan, lambda x: full(x) + 1)
    )))


def mix(docs: DataFrame, weights: dict[str, int], rest: int = 1, block_docs: int = BLOCK_DOCS, ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with mix_source, mix_block (long, within the source), mix_slot (long, the block's
    place in the mix) and mix_pos (int, within the block).

    ``weights`` gives positive integers by source; all other sources, null among them, are one pool
    of weight ``rest``. Every row is placed once, none is dropped or repeated. While all sources
    last the mix has the target weights, less than one block off at any slot; a source that runs
    out leaves its share to the others. Inside a source rows are ordered by the MD5 of their doc_id
    (null: of an empty text), then by doc_id and the columns of ``ties``; rows equal in all of these
    are interchangeable. An empty table gives an empty result. Input columns named like the new ones
    are replaced. The number of weights bounds all that the driver sees: blocks per source.
    """
    spark = prepared(docs.sparkSession)
    names = [*sorted(weights), REST]
    parts = [*[weights[n] for n in sorted(weights)], rest]
    if min(parts) < 1:
        raise ValueError("weights are positive integers")
    source = F.coalesce(F.when(F.col("source").isin(list(weights)), F.col("source")), F.lit(REST))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    added = ("mix_source", "mix_block", "mix_slot", "mix_pos")
    own = [c for c in docs.columns if c not in added]
    work = docs.select(*own).withColumns({"mix_source": source, "_key": key})
    work = work.withColumn("_chunk", F.substring("_key", 1, CHUNK_DIGITS))

    counts = materialize(work.groupBy("mix_source", "_chunk").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("mix_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("mix_source", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    sizes = counts.groupBy("mix_source").agg(F.ceil(F.sum("_n") / block_docs).cast("long").alias("b")).collect()
    plan = _plan({r.mix_source: r.b for r in sizes}, names, parts)
    edges = _edges(plan)

    left = lambda x: F.greatest(F.least(x["w"], x["b"] - x["w"] * F.col("_shape")), F.lit(0).cast("long"))
    shapes = spark.range(1).select(F.explode(edges).alias("_shape"))
    slots = shapes.select("_shape", F.posexplode(period_schedule(F.transform(plan, left))).alias("_at", "i"))
    nth = F.row_number().over(Window.partitionBy("_shape", "i").orderBy("_at")) - 1
    slots = slots.select(
        "_shape", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("mix_source"), nth.alias("_k"), "_at"
    )

    spot = Window.partitionBy("mix_source", "_chunk").orderBy("_key", "doc_id", *ties)
    row = F.col("_off") + F.row_number().over(spot) - 1
    weight = F.element_at(F.create_map(*[F.lit(v) for pair in zip(names, parts) for v in pair]), F.col("mix_source"))
    period = F.floor(F.col("mix_block") / F.col("_w")).cast("long")
    start = F.aggregate(plan, F.lit(0).cast("long"), lambda a, x: a + F.least(x["b"], x["w"] * F.col("_period")))
    placed = (
        work.join(offsets.hint("merge"), ["mix_source", "_chunk"])
        .withColumn("_r", row.cast("long"))
        .withColumns({"mix_block": F.floor(F.col("_r") / block_docs).cast("long"), "mix_pos": (F.col("_r") % block_docs).cast("int"), "_w": weight})
        .withColumns({"_period": period, "_k": (F.col("mix_block") % F.col("_w")).cast("int")})
        .withColumns({"_shape": F.array_max(F.filter(edges, lambda e: e <= F.col("_period"))), "_start": start})
    )
    # At most (2 * sources + 1) periods of sum(weights) slots: bounded by the weights given.
    where = F.broadcast(slots)
    return placed.join(where, ["_shape", "mix_source", "_k"]).select(
        *own, "mix_source", "mix_block", (F.col("_start") + F.col("_at")).cast("long").alias("mix_slot"), "mix_pos"
    )


def text_tie() -> Column:
    """What orders rows of one source and doc_id, also where the text itself is no longer at hand."""
    return F.xxhash64("text")


def in_mix_order(docs: DataFrame, weights: dict[str, int], rest: int = 1) -> DataFrame:
    """The rows in the order of the mix, with their own columns; every row once.

    Readers of the written rows need not meet them in this order. Their places follow from the rows
    alone: :func:`mix` gives each its own again, with :func:`text_tie` among the ties.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", text_tie().alias("_tie"))
    return mix(whole, weights, rest, ties=("_tie",)).orderBy("mix_slot", "mix_pos").select("_doc.*")
