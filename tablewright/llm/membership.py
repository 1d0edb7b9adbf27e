"""Keep rows whose key may be among wanted keys, before an exact join shuffles them.

The wanted keys become a bitmap of about ten bits a key, between 8 KB and
``MOST_BITS`` bits, so that the broadcast is bounded. A full bitmap only lets more
rows through; the join that follows decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .folds import sum_vectors
from .textcore import column, mix64

MOST_BITS = 1 << 27


def _bits(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = mix64(keys.view(np.uint64))
    for shift in (0, 24, 37):
        yield (h >> np.uint64(shift)) & np.uint64(size - 1)


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose long ``key`` may be among ``wanted``'s; rows with a null key go."""
    n = wanted.count()
    size = min(MOST_BITS, max(1 << 16, 1 << (10 * max(1, n)).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=bool)
        for batch in batches:
            for at in _bits(batch.column(0).drop_null().to_numpy(), size):
                seen[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())], ["v"])

    found = sum_vectors(wanted.select(wanted_key).mapInArrow(mark, "v binary"), "v", np.uint8, fan_in=4, add=np.bitwise_or)
    bitmap = rows.sparkSession.sparkContext.broadcast(np.zeros(size // 8, np.uint8) if found is None else found)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, key)
            passed = keys.is_valid().to_numpy(zero_copy_only=False).copy()
            for at in _bits(keys.fill_null(0).to_numpy(), size):
                passed &= (bitmap.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            if passed.any():
                yield batch.filter(pa.array(passed))

    return rows.mapInArrow(keep, rows.schema)
