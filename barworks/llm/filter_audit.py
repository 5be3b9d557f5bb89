"""Interaction of quality filters, from sorted posting lists of the documents that fail each one.

One pass over the texts gives every document the filters it fails. The slim rows are dealt by ranges
of doc_id, and a task keeps, for a part and a range, one sorted list of failing ids per filter, and
one each of good and of toxic documents. Unions and differences of the lists are merged by galloping:
an id looks for its place in the other list outward from a guess, in doubling steps. Only sizes leave
the task; summed over the ranges they answer every order of the filters.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barworks.llm.arrow import as_bytes, prepared
from barworks.operators.ordered import join_per_key
from barworks.session import materialize

FILTERS = "ABCDE"
GOOD, TOXIC = 5, 6  # bits after those of the filters
RANGE_IDS = 1 << 16  # ids of a part that are merged at a time
PIECE = 1 << 20  # bytes of a text that are split into words at a time
SALTS = 8  # copies of the labels, so that rows of a repeated id meet them in several tasks
ALL = (1 << len(FILTERS)) - 1
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_SYMBOL = re.compile(rb"[#$%&*|]")


def word_counts(text: bytes) -> tuple[int, int]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, all and distinct; long texts go piece by piece."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    count, seen, start = 0, set(), 0
    while start < len(text):
        gap = _WHITE.search(text, start + PIECE)
        stop = gap.start() if gap else len(text)
        words = text[start:stop].split()
        count += len(words)
        seen.update(words)
        start = stop
    return count, len(seen)


def own_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    rules = words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, _SYMBOL.search(text) is not None
    return sum(1 << i for i, failed in enumerate(rules) if failed)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        fails = pa.array([own_failures(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), digests, fails], ["part", "doc_id", "digest", "fails"])


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, doc_id, row, bits) per document: bits 0 to 4 are the filters that it fails, 5 and 6
    say that it is labelled good and toxic. ``row`` tells rows with one doc_id apart."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    judged = rows.mapInArrow(_judged, "part string, doc_id long, digest binary, fails int")
    judged = materialize(judged.withColumn("row", F.monotonically_increasing_id()))
    copies = judged.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1 << GOOD).otherwise(0)).alias("_good"),
        F.max(F.when(F.col("toxic") == 1, 1 << TOXIC).otherwise(0)).alias("_toxic"),
    )
    # Both tables grow with the documents and come several times, so neither goes through the driver.
    known = join_per_key(judged, copies.drop("_last"), ["digest"], "left", hint="merge").drop("digest")
    known = join_per_key(known, marks, ["doc_id"], "left", SALTS, hint="merge")
    repeats = F.when(F.col("doc_id") > F.col("_first"), 1 << FILTERS.index("E")).otherwise(0)
    bits = F.col("fails") + repeats + F.coalesce("_good", F.lit(0)) + F.coalesce("_toxic", F.lit(0))
    return known.select("part", "doc_id", "row", bits.cast("int").alias("bits"))


def gallop(ids: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Place of each id in the sorted list ``within``, before equal ones.

    Every id starts at its proportional place, goes outward in doubling steps until it is enclosed
    and bisects the enclosure, so near neighbours cost a step or two.
    """
    n = len(within)
    low = np.arange(len(ids), dtype=np.int64) * n // max(1, len(ids))
    high = low.copy()
    step = 1
    while n:
        down = (low > 0) & (within[np.maximum(low - 1, 0)] >= ids)
        up = (high < n) & (within[np.minimum(high, n - 1)] < ids)
        if not (down.any() or up.any()):
            break
        low = np.where(down, np.maximum(low - step, 0), low)
        high = np.where(up, np.minimum(high + step, n), high)
        step *= 2
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = open_ & (within[np.minimum(middle, n - 1)] < ids)
        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
    return low


def is_in(ids: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Which ids of a sorted list are in another."""
    if not len(within):
        return np.zeros(len(ids), dtype=bool)
    at = gallop(ids, within)
    return (at < len(within)) & (within[np.minimum(at, len(within) - 1)] == ids)


def difference(ids: np.ndarray, without: np.ndarray) -> np.ndarray:
    return ids[~is_in(ids, without)]


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted ids that any of the sorted lists has: the shorter ones are merged into the longest."""

    def merged(whole: np.ndarray, ids: np.ndarray) -> np.ndarray:
        new = difference(ids, whole)
        return np.insert(whole, gallop(new, whole), new)

    return reduce(merged, sorted(lists, key=len, reverse=True), np.empty(0, dtype=np.int64))


def sizes_of(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray, n: int) -> list[tuple[int, int, int, int, int]]:
    """(filter, mask, documents, good, toxic) of a range of n documents.

    With filter -1, the documents that pass all filters of the mask; otherwise those that fail the
    filter and pass the filters of the mask.
    """
    unions = [union([ids for i, ids in enumerate(lists) if mask >> i & 1]) for mask in range(ALL + 1)]
    out = [(-1, mask, n - len(u), 0, 0) for mask, u in enumerate(unions)]
    for i, ids in enumerate(lists):
        for mask in range(ALL + 1):
            if not mask >> i & 1:
                left = difference(ids, unions[mask])
                out.append((i, mask, len(left), int(is_in(left, good).sum()), int(is_in(left, toxic).sum())))
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """Part and bits of up to RANGE_IDS documents at a time, from rows sorted by part and id."""
    part, held, count = None, [], 0
    for batch in batches:
        parts = batch.column("part").to_pylist()
        bits = batch.column("bits").to_numpy(zero_copy_only=False)
        cuts = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and (parts[start] != part or count >= RANGE_IDS):
                yield part, np.concatenate(held)
                held, count = [], 0
            if stop > start:
                part = parts[start]
                held.append(bits[start:stop])
                count += stop - start
    if held:
        yield part, np.concatenate(held)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, bits in _ranges(batches):
        # Ids of a posting list are places in the id order of the range: rows may share a doc_id.
        *lists, good, toxic = (np.flatnonzero(bits & (1 << i)) for i in range(len(FILTERS) + 2))
        columns = [pa.array(c, pa.int64()) for c in zip(*sizes_of(lists, good, toxic, len(bits)))]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0])), *columns], ["part", "filter", "mask", "docs", "good", "toxic"])


def subset_sizes(marked: DataFrame) -> DataFrame:
    """(part, filter, mask, docs, good, toxic): :func:`sizes_of` summed over all ranges of a part."""
    dealt = marked.repartitionByRange("doc_id", "row").sortWithinPartitions("part", "doc_id", "row")
    sizes = dealt.mapInArrow(_merged, "part string, filter long, mask long, docs long, good long, toxic long")
    return sizes.groupBy("part", "filter", "mask").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley): one row per language, order of the five filters and step, zeros included.

    A document fails A with under 200 words, B with under 50 distinct ones in a hundred, C with over
    3 capitals A-Z in a hundred characters, D with any of ``#$%&*|`` and E where its text is that of
    a smaller doc_id anywhere in the table. Null texts are empty, null languages are the empty part.
    Rows are counted one by one: rows with one doc_id are documents of their own and no copies of
    each other; a row without doc_id is no copy, and has no label. A doc_id labelled more than once
    is good or toxic if any of its labels says so. Other columns are ignored; an empty table gives an
    empty result.
    """
    prepared(docs.sparkSession)
    sizes = materialize(subset_sizes(materialize(failures(docs, labels))))
    before = F.bit_count("mask")
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), before + 1)
    others = F.expr(f"{ALL} - shiftleft(1, CAST(filter AS INT))")
    alone = sizes.where("filter >= 0").groupBy("part", "filter").agg(
        F.max(F.when(F.col("mask") == 0, F.col("docs"))).alias("fails"),
        F.max(F.when(F.col("mask") == others, F.col("docs"))).alias("unique_fails"),
        F.sum(F.col("docs") * orders).alias("shapley"),
    )
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, i in enumerate(order):
            mask = sum(1 << j for j in order[:step])
            steps.append(("".join(FILTERS[j] for j in order), step + 1, i, mask, mask | 1 << i))
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter long, mask long, after long")
    passed = sizes.where("filter < 0").select("part", F.col("mask").alias("after"), F.col("docs").alias("kept"))
    found = sizes.join(steps, ["filter", "mask"]).join(alone, ["part", "filter"]).join(passed, ["part", "after"])
    return found.select(
        "part", "filter_order", "step", "kept", F.col("docs").alias("removed"), (F.col("fails") - F.col("docs")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )
