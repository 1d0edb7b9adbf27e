"""Vectorised words and hashes over Arrow string buffers (numpy, no Python object per word)."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = max(n, 2 * len(_tables[0]), 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[k] = np.cumprod(steps, dtype=np.uint64)
    return _tables[0], _tables[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Words(NamedTuple):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block of texts; byte positions are in ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text, its first word; one more at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; no word crosses two texts."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    raw = data.tobytes()  # bytes are translated faster than arrays are indexed
    if lower:
        data = np.frombuffer(raw.translate(_LOWER.tobytes()), dtype=np.uint8)
    n = len(data)
    begin = np.frombuffer(raw.translate((~_SPACE).tobytes()), dtype=bool).copy()
    end = begin.copy()
    if n:
        solid = begin.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begin[cut] = solid[cut]
        end[cut - 1] = solid[cut - 1]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans. Memory is bounded by the block or the longest span."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + block, side="right")))
        part = data[at : int(ends[j - 1])]
        up, down = _powers(len(part) + 1)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        terms = part.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[: len(part)]
        np.cumsum(terms, out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours; one run for each start."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(words) + 1)
    sums = np.empty(len(words) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix64((sums[n:] - sums[:-n]) * down[:m] + np.uint64(n))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8), offsets


def trim() -> None:
    """Give freed memory back to the system; a reused worker would keep it otherwise."""
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each have at most ``most`` bytes, or are one text."""
    for batch in batches:
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        trim()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pack(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Rows of bytes without a Python object each: row ``i`` holds ``values[cuts[i]:cuts[i + 1]]``."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim == 2 else 1)
    offsets = (np.asarray(cuts, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unpack(rows: pa.Array | pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of bytes one after another, and how many each row has."""
    rows = rows.cast(pa.large_binary())
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    _, offsets, data = rows.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
    size = np.dtype(dtype).itemsize
    values = np.frombuffer(data, dtype=dtype, count=int(offsets[-1] - offsets[0]) // size, offset=int(offsets[0])) if data and offsets[-1] > offsets[0] else np.empty(0, dtype)
    return values, np.diff(offsets) // size


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
