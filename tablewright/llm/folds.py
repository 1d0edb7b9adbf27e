"""Folds of documents by the checksum of their id, and sums of vectors over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sum_vectors(parts: DataFrame, column: str, dtype, fan_in: int = 64, add=np.add, summed: bool = False) -> np.ndarray | None:
    """Sum (or another ``add``) of the equally long vectors in a binary column, by a tree of partial sums.

    ``parts`` has a few rows per partition, or one (``summed``), which saves each task a second
    Python worker. No task gets more than a few times
    ``fan_in`` vectors; the driver gets at most ``fan_in``. None for an empty table.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                vector = np.frombuffer(raw.as_buffer(), dtype=dtype)
                total = vector.copy() if total is None else add(total, vector)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    found = parts.select(F.col(column).alias("v"))
    if not summed:
        found = found.mapInArrow(merge, "v binary")  # one per partition
    n = found.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        found = found.repartition(n).mapInArrow(merge, "v binary")
    total = None
    for r in found.collect():
        vector = np.frombuffer(r["v"], dtype=dtype)
        total = vector.copy() if total is None else add(total, vector)
    return total
