"""Exact top-k search by inner product: a three-phase uniform threshold over parts of the vectors.

Vectors are cut into parts of their dimensions, and each part is a list of partial scores. Phase 1
takes the best of every list; their sums give a score that the k-th result reaches at least. Phase 2
sends a uniform threshold to all lists: a vector that is below it in every part cannot reach that
score, so only entries above it are collected. Phase 3 resolves the partial scores that are still
unknown for the few vectors whose upper bound reaches the k-th lower bound.

Vectors are dealt to lanes. A task holds the vectors of a lane, reads the queries row by row behind
them, and compares both in blocks; a vector is moved once a phase, and a query once per lane. Equal
vectors are one candidate that stands for its ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barworks.llm.arrow import prepared
from barworks.session import materialize

PARTS = 4
QUERY_ROWS, VECTOR_ROWS = 256, 4096  # of a block
LANE_LEAST, LANE_MOST = 8192, 1 << 17  # vectors of a lane; queries and results move once per lane
LARGEST = 1 << 60  # partial scores from here on raise, so that sums and differences of them fit a long
SALTS = 16


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 * x) of every component; each (id, vector) once.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without
    id. A component that no long can hold raises.
    """
    scaled = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("s", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("s"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("s").isNotNull() & good)
    too_large = F.raise_error(F.lit("a component is too large for a score")).cast("long")
    whole = F.transform("s", lambda x: F.when(F.abs(x * 1024) < float(1 << 63), F.floor(x * 1024).cast("long")).otherwise(too_large))
    return rows.select("vec_id", whole.alias("v")).distinct()


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), dim)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest signed type from 16 bits on that holds them."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    fits = (t for t in (np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return values.astype(next(fits, np.int64))


def _top(values: np.ndarray) -> float:
    return float(np.abs(values.astype(float)).max(initial=0))


def _scores(queries: np.ndarray, vectors: np.ndarray, top: float) -> np.ndarray:
    """Inner products, none beyond ``top``; in floating point where that is exact, and in whole numbers
    of any size where a long could overflow. A score that does not fit raises."""
    for kind, exact in ((np.float32, 2**24), (np.float64, 2**52)):
        if top < exact:
            return queries.astype(kind) @ vectors.astype(kind).T
    if top < LARGEST:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    exact = queries.astype(object) @ vectors.astype(object).T
    if np.abs(exact).max(initial=0) >= LARGEST:
        raise OverflowError("a score is too large for a long")
    return exact.astype(np.int64)


def _cut(dim: int) -> list[slice]:
    edges = [dim * p // PARTS for p in range(PARTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some queries, their values, and the ids and values of all vectors of their lane, from rows sorted
    by dim, lane and kind: vectors are of kind 0 and come first."""
    at, held, whole = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "lane", "kind")])
        cuts = [0, *(np.flatnonzero(np.diff(keys).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            dim, lane, kind = keys[:, start].tolist()
            if (dim, lane) != at:
                at, held, whole = (dim, lane), [], None
            rows = batch.slice(start, stop - start)
            if not kind:
                held.append((rows.column("id").to_numpy(), _narrow(_matrix(pa.chunked_array([rows.column("v")]), dim))))
                continue
            if held:
                whole, held = tuple(map(np.concatenate, zip(*held))), []
            for first in range(0, rows.num_rows if whole else 0, QUERY_ROWS):
                some = rows.slice(first, QUERY_ROWS)
                yield some, _matrix(pa.chunked_array([some.column("v")]), dim), *whole


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _tops_of(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query: the k highest scores, the places of their vectors, and the least score of all."""
    top = _top(q) * _top(v) * q.shape[1]
    best = place = least = None
    for start in range(0, len(v), VECTOR_ROWS):
        s = _scores(q, v[start : start + VECTOR_ROWS], top)
        if best is None:
            place = _best(s, k)
            best, least = np.take_along_axis(s, place, 1), s.min(axis=1)
            continue
        np.minimum(least, s.min(axis=1), out=least)
        better = np.flatnonzero((s.max(axis=1) > best.min(axis=1)) | (best.shape[1] < k))
        if len(better):
            both = np.concatenate((best[better], s[better]), axis=1)
            at = _best(both, k)
            columns = np.concatenate((place[better], np.broadcast_to(np.arange(start, start + s.shape[1]), s[better].shape)), axis=1)
            if at.shape[1] > best.shape[1]:  # then no row had k yet, so all are here
                best, place = np.empty(at.shape, best.dtype), np.empty(at.shape, place.dtype)
            best[better], place[better] = np.take_along_axis(both, at, 1), np.take_along_axis(columns, at, 1)
    return best.astype(np.int64), place, least.astype(np.int64)


def _list_tops(k: int):
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, q, v_ids, v in _met(batches):
            for p, part in enumerate(_cut(q.shape[1])):
                best, place, least = _tops_of(q[:, part], v[:, part], k)
                width = best.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rows.column("id").to_numpy(), width)), pa.array(np.full(best.size, p, np.int32)),
                     pa.array(v_ids[place].ravel()), pa.array(best.ravel()), pa.array(np.repeat(least, width))],
                    ["query", "part", "cand", "s", "least"],
                )

    return tops


def _entries(k: int):
    """Entries at or above the query's threshold, without those that cannot be among its k best
    because k others of the same lane are known to be better."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, q, v_ids, v in _met(batches):
            least = np.array(rows.column("least").to_pylist(), dtype=np.int64)
            cut, base = (rows.column(c).to_numpy().astype(np.int64)[:, None] for c in ("cut", "base"))
            top = _top(q) * _top(v) * max(1, q.shape[1])
            small = max(top, _top(least), _top(base)) < 2**24
            kind = np.int32 if small else np.int64
            least, cut, base = least.astype(kind), cut.astype(kind), base.astype(kind)
            unseen = np.maximum(cut - 1, 0)
            found = []
            for start in range(0, len(v), VECTOR_ROWS):
                block = v[start : start + VECTOR_ROWS]
                known = np.zeros((len(q), len(block)), dtype=kind)
                missing = np.full(known.shape, PARTS, dtype=np.int8)
                for p, part in enumerate(_cut(q.shape[1])):
                    s = _scores(q[:, part], block[:, part], top).astype(kind)
                    s -= least[:, p : p + 1]
                    seen = s >= cut
                    s *= seen
                    known += s
                    missing -= seen
                if known.shape[1] >= k:
                    base = np.maximum(base, np.partition(known, -k, axis=1)[:, [-k]])
                upper = missing * unseen
                upper += known
                row, col = np.nonzero((upper >= base) & (missing < PARTS))
                found.append((row, col + start, known[row, col].astype(np.int64), upper[row, col].astype(np.int64)))
            row, col, some, upper = map(np.concatenate, zip(*found))
            order = np.lexsort((-some, row))
            place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            last = order[place == k - 1]
            bound = base[:, 0].astype(np.int64)
            bound[row[last]] = np.maximum(bound[row[last]], some[last])
            may = upper >= bound[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.column("id").to_numpy()[row[may]]), pa.array(v_ids[col[may]]), pa.array(some[may]), pa.array(upper[may])],
                ["query", "cand", "known", "upper"],
            )

    return entries


def classes(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (cand, v), and their ``keep`` smallest ids (cand, vec_id).

    A vector shared by very many ids is thinned in salted groups first; ids beyond the smallest
    ``keep`` cannot be among as many results.
    """
    salted = vectors.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    first = F.row_number().over(Window.partitionBy("v", "_salt").orderBy("vec_id"))
    some = salted.withColumn("_r", first).where(F.col("_r") <= keep)
    then = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    some = some.withColumn("_r", then).where(F.col("_r") <= keep)
    some = some.withColumn("cand", F.min("vec_id").over(Window.partitionBy("v")))
    # An id may occur with several vectors, so a class is named by its hash together with the id.
    some = materialize(some.select(F.xxhash64("cand", "v").alias("cand"), "v", "vec_id", "_r"))
    return some.where("_r = 1").select("cand", "v"), some.select("cand", "vec_id")


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, exactly.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the
    query's own (:func:`quantised` says which take part). Ties go to the smaller vec_id; fewer
    candidates than k give fewer results. Vectors compare with those of their own length only.
    Repeated rows count once. An empty table gives an empty result; other columns are ignored.
    """
    prepared(embeddings.sparkSession)
    vectors = materialize(quantised(embeddings))
    # The query's own row may be among the best, so one more is kept throughout.
    wide = k + 1
    cands, ids = classes(vectors, wide)
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = materialize(queries.select(F.xxhash64("vec_id", "v").alias("query"), "vec_id", "v"))
    n_cands = cands.count()
    parts = max(2, int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lanes = max(1, math.ceil(n_cands / LANE_MOST), min(math.ceil(n_cands / LANE_LEAST), parts))
    in_lane = F.pmod(F.xxhash64("cand"), F.lit(lanes)).cast("int")
    vector_rows = cands.select(F.size("v").alias("dim"), in_lane.alias("lane"), F.lit(0).alias("kind"), F.col("cand").alias("id"), "v")

    def dealt(asked: DataFrame, *told: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
        query_rows = asked.select(F.size("v").alias("dim"), every, F.lit(1).alias("kind"), F.col("query").alias("id"), "v", *told)
        rows = vector_rows.unionByName(query_rows, allowMissingColumns=True)
        return rows.repartition(max(parts, lanes), "dim", "lane").sortWithinPartitions("dim", "lane", "kind")

    tops = materialize(dealt(queries).mapInArrow(_list_tops(wide), "query long, part int, cand long, s long, least long"))
    least = tops.groupBy("query", "part").agg(F.min("least").alias("least"))
    order = F.row_number().over(Window.partitionBy("query", "part").orderBy(F.col("s").desc(), "cand"))
    best = tops.drop("least").withColumn("_r", order).where(F.col("_r") <= wide).join(least, ["query", "part"])
    sums = best.groupBy("query", "cand").agg(F.sum(F.col("s") - F.col("least")).alias("known"))
    low = Window.partitionBy("query").orderBy(F.col("known").desc())
    base = sums.withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= wide).groupBy("query").agg(
        F.when(F.count(F.lit(1)) == wide, F.min("known")).otherwise(0).alias("base")
    )
    lists = least.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("part", "least"))).alias("l"))
    limits = lists.join(base, "query").select(
        "query", F.col("l.least").alias("least"), F.ceil(F.col("base") / PARTS).cast("long").alias("cut"), "base"
    )
    limits = materialize(limits)
    told = dealt(queries.join(limits, "query"), "least", "cut", "base")
    entries = materialize(told.mapInArrow(_entries(wide), "query long, cand long, known long, upper long"))
    lower = entries.withColumn("_r", F.row_number().over(low)).where(F.col("_r") == wide).select("query", F.col("known").alias("floor"))
    open_ = entries.join(lower, "query", "left").where("floor IS NULL OR upper >= floor").select("query", "cand")

    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    exact = open_.join(cands, "cand").join(queries.select("query", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query")
    exact = exact.select("query", "query_id", "cand", (F.col("q") == F.col("v")).alias("same"), product.alias("score"))
    found = exact.join(ids, "cand").where("NOT (same AND vec_id = query_id)")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
