"""Token-ID output in training order: fixed-stride shards at the slots of a keyed permutation.

Every sequence has a dense number, and a Feistel network with cycle-walking turns the number into
its slot in the epoch: a bijection that needs the key alone and no table. Shards are ranges of
slots. Each holds the same number of sequences of the same stride, so slot s is at row
``s % per_shard`` of shard ``s // per_shard`` and a reader resumes at any slot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from barworks.llm.arrow import as_bytes, prepared
from barworks.llm.shingles import mix
from barworks.session import materialize

LENGTH = 512  # tokens in a sequence
END_OF_TEXT = 256  # after the 256 byte values
PER_SHARD = 8192
CHUNKS = 1 << 16  # in which documents are numbered
WRITERS = 1 << 16  # tasks that write shards, at most
OUT_BYTES = 1 << 22  # of ids that a task cuts at a time
ROUNDS = 6
KEY = 20260101


def feistel(number: np.ndarray, total: int, key: int) -> np.ndarray:
    """Slot of each number below ``total``: a permutation of 0 .. total - 1 for every key.

    The network permutes the smallest even power of two that holds ``total``; a value outside is
    sent through it again until it falls inside, which takes fewer than four rounds on average.
    """
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key % 2**63))

    def through(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        return (left << np.uint64(half)) | right

    out = through(number.astype(np.uint64))
    outside = np.flatnonzero(out >= total)
    while len(outside):
        out[outside] = through(out[outside])
        outside = outside[out[outside] >= total]
    return out.astype(np.int64)


def id_type(end: int) -> str:
    """How ids up to ``end`` are written: little-endian unsigned integers of 16 or 32 bits."""
    return "<u2" if end < 1 << 16 else "<u4"


def narrowed(end: int):
    """For an encoder whose ids are 32-bit integers: the ids of a text as :func:`id_type` writes them."""
    written = id_type(end)
    return lambda ids, _: (np.frombuffer(ids, "<u4").astype(written).tobytes(),)


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _numbered(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, raw, chunk, before): every document with the number of sequences before it in its
    chunk; and the number of sequences before each chunk, the total as the last.

    Rows are numbered in the order of (chunk, doc_id, hash of the ids), the chunk being a hash of the
    other two, so numbers depend on nothing but the documents. Equal rows are told apart by any
    order: they have the same ids. The ids move once, and the files that moved them go when the
    numbered rows are written.
    """
    spark = rows.sparkSession
    inside = Window.partitionBy("chunk").orderBy("doc_id", "hash", "n").rowsBetween(Window.unboundedPreceding, 0)
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(CHUNKS)).cast("int"))
    numbered = chunked.withColumn("before", F.sum("n").over(inside) - F.col("n")).drop("hash")
    with _dropping_shuffles(spark):
        numbered = materialize(numbered, compression="zstd")
    tops = np.zeros(CHUNKS + 1, dtype=np.int64)
    for chunk, n in numbered.groupBy("chunk").agg(F.sum("n")).collect():
        tops[chunk + 1] = n
    return numbered, np.cumsum(tops)


def write_training_order(
    docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end: int = END_OF_TEXT, given: str = "<u4"
) -> int:
    """Write all sequences of ``docs`` to shards under ``path`` and return how many there are.

    Documents are rows (doc_id, ids), with the ids of any tokenizer as integers of the type ``given``
    below the end-of-text id ``end``, or rows (doc_id, text) where ``ids`` is no column of bytes:
    then each byte of a text is an id and 256 ends it. A document is its ids and an end-of-text id,
    cut into sequences of ``length`` ids; the last is filled up with end-of-text ids. Rows are (slot,
    doc_id, piece, n_tokens, payload), the payload ``length`` integers of :func:`id_type`, ordered by
    slot inside each shard folder; a task writes a range of shards. Slots follow from the key and the
    documents alone, whatever files they lie in. Null and empty texts or ids give one sequence;
    repeated rows give sequences of their own; other columns are ignored; an empty table writes no
    shard. The written shards are checked to hold every slot once.
    """
    spark = prepared(docs.sparkSession)
    source = "ids" if dict(docs.dtypes).get("ids") == "binary" else "text"
    if source == "text" and end != END_OF_TEXT:
        raise ValueError("bytes of texts end with the id 256")
    held, written = np.dtype(given if source == "ids" else "u1"), np.dtype(id_type(end))
    raw = F.coalesce(F.col(source).cast("binary"), F.lit(b""))
    count = F.ceil((F.octet_length(raw) / held.itemsize + 1) / length).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(raw).alias("hash"), count.alias("n"), raw.alias("raw"))
    numbered, tops = _numbered(rows)
    total = int(tops[-1])
    shards = max(1, math.ceil(total / per_shard))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = length * written.itemsize
        for batch in batches:
            starts_ = tops[batch.column("chunk").to_numpy()] + batch.column("before").to_numpy()
            counts = batch.column("n").to_numpy()
            names, raws = batch.column("doc_id"), as_bytes(batch.column("raw"))
            first = 0
            while first < len(raws):
                last, size = first, 0
                while last < len(raws) and size < OUT_BYTES:
                    size += len(raws[last])
                    last += 1
                n = counts[first:last]
                piece = np.concatenate([np.arange(k) for k in n])
                slot = feistel(np.repeat(starts_[first:last], n) + piece, total, key)
                tokens = np.full(len(slot), length, dtype=np.int32)
                out = []
                for raw_, k in zip(raws[first:last], n.tolist()):
                    ids = np.frombuffer(raw_, held)
                    if source == "ids" and len(ids) and ids.max() >= end:
                        raise ValueError(f"id {ids.max()} is not below the end-of-text id {end}")
                    data = raw_ if held == written else ids.astype(written).tobytes()
                    out += [data[i * width : (i + 1) * width] for i in range(k)]
                    tokens[len(out) - 1] = len(ids) - (k - 1) * length + 1
                docs_ = names.slice(first, last - first).take(pa.array(np.repeat(np.arange(last - first), n)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), docs_, pa.array(piece.astype(np.int32)), pa.array(tokens), pa.array(out, pa.binary())],
                    ["slot", "doc_id", "piece", "n_tokens", "bytes"],
                )
                first = last

    slots = numbered.mapInArrow(cut, "slot long, doc_id long, piece int, n_tokens int, bytes binary")
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    tasks = min(shards, WRITERS)
    dealt = slots.withColumn("shard", shard).repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / shards).cast("int"))
    # The end-of-text id fills a sequence up, also where it ends its text.
    fill = F.lit(np.array([end], dtype=written).tobytes())
    payload = F.rpad("bytes", F.lit(length * written.itemsize), fill).alias("payload")
    ordered = dealt.sortWithinPartitions("shard", "slot").select("shard", "slot", "doc_id", "piece", "n_tokens", payload)
    ordered.write.partitionBy("shard").parquet(path, compression="zstd")
    if total:
        _check(spark, path, total, per_shard)
    return total


def _check(spark: SparkSession, path: str, total: int, per_shard: int) -> None:
    """Every shard holds as many sequences as its range of slots has, without repeats."""
    found = read_shards(spark, path).select("shard", "slot").groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.bit_xor(F.xxhash64("slot")).alias("x")
    )
    right = (F.col("lo") == F.col("shard").cast("long") * per_shard) & (F.col("hi") == F.least((F.col("shard") + 1).cast("long") * per_shard, F.lit(total)) - 1)
    row = found.agg(F.sum("n"), F.count(F.when(~right | (F.col("n") != F.col("hi") - F.col("lo") + 1), 1))).first()
    if row[0] != total or row[1]:
        raise RuntimeError("the input changed while it was read; write it to a table first")


def read_shards(spark: SparkSession, path: str, from_slot: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """Sequences from a slot on; earlier shards are not read."""
    schema = "slot long, doc_id long, piece int, n_tokens int, payload binary, shard int"
    return spark.read.schema(schema).parquet(path).where((F.col("shard") >= from_slot // per_shard) & (F.col("slot") >= from_slot))
