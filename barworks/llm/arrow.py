"""Small helpers for functions that receive Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from barworks.session import configure

# Whole texts travel in these batches, so a batch holds few rows.
BATCH_ROWS = "2000"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators of this package rely on."""
    configure(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of a column; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys in batches that arrive sorted by them.

    Only the open run is held in memory.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        at = list(zip(*columns))
        cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and at[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = at[start]
    if held:
        yield pa.Table.from_batches(held)


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Arrow longs with the same bits."""
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64))
