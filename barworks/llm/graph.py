"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barworks.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    Each step links every neighbour of a node to the smallest one, first among all neighbours and
    then among the smaller ones, so trees flatten in a logarithmic number of rounds and the number
    of links never grows. A node with very many neighbours is pre-aggregated to its minimum and
    meets its links in a join that adaptive execution can split. Links to itself and null ends are
    ignored; an empty table gives an empty result. Every round is written to the shared folder.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    links = materialize(links)
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(root, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(root.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = materialize(small)
        now = _state(links)
        if now == before:
            break
        before = now
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def _state(links: DataFrame) -> tuple[int, int | None]:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
