"""Best-fit-decreasing packing of token documents into fixed-length sequences.

Piece lengths are whole numbers up to the capacity, so the exact global packing
depends only on how many pieces each length has. The driver packs that histogram
(at most ``capacity`` numbers, however large the corpus): a segment tree over the
remaining capacities of open bins finds the tightest bin in logarithmic time, and
all pieces and bins of the same kind move together. The resulting plan is a list
of moves; executors look up each piece's place from its rank among the pieces of
its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staged
from .textcore import column
from .tokens import encode


class OpenBins:
    """Groups of equal open bins by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def push(self, remaining: int, first: int, bins: int) -> None:
        self.groups.setdefault(remaining, []).append((first, bins))
        at = remaining + self.size
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def pop(self, remaining: int) -> tuple[int, int]:
        group = self.groups[remaining].pop()
        if not self.groups[remaining]:
            at = remaining + self.size
            self.tree[at] = 0
            at >>= 1
            while at and not (self.tree[2 * at] or self.tree[2 * at + 1]):
                self.tree[at] = 0
                at >>= 1
        return group

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open bin has."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.tree[2 * at])
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Moves (length, first rank, first bin, pieces per bin, offset), sorted by length and rank.

    From ``first rank`` on, pieces of ``length`` fill bin after bin from ``first
    bin``, ``pieces per bin`` in each, beginning at ``offset``.
    """
    bins, moves, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = bins.tightest(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                first, n = bins.pop(remaining)
                each = remaining // length
            full = min(n, left // each)
            for take, per in ((full, each), (min(1, n - full) if left - full * each else 0, left - full * each)):
                if take and per:
                    per = min(per, each)
                    moves.append((length, rank, first, per, capacity - remaining))
                    rank, left = rank + take * per, left - take * per
                    bins.push(remaining - per * length, first, take)
                    first, n = first + take, n - take
            if n:
                bins.push(remaining, first, n)
    return np.array(sorted(moves), dtype=np.int64).reshape(-1, 5)


def place(plan: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    keys = plan[:, 0].astype(np.uint64) << np.uint64(50) | plan[:, 1].astype(np.uint64)
    at = np.searchsorted(keys, lengths.astype(np.uint64) << np.uint64(50) | ranks.astype(np.uint64), side="right") - 1
    move, nth = plan[at], ranks - plan[at, 1]
    return move[:, 2] + nth // move[:, 3], move[:, 4] + nth % move[:, 3] * lengths


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` tokens; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, *, doc_id: str, text: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids: doc_id, piece, start, length, ids_crc32 and, if wanted, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                rows: list[list] = [[] for _ in names]
                part = batch.slice(low, 1024)
                for key, body in zip(column(part, "doc_id").to_pylist(), column(part, "text"), strict=True):
                    ids = np.append(encode(body.as_py(), added=True), np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        raw = ids[start : start + length].tobytes()
                        for to, value in zip(rows, (key, k, start, length, zlib.crc32(raw), raw), strict=False):
                            to.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids, little-endian uint32, with ``keep_ids``): one row per piece. A document is its
    ids and ``end_id``; documents longer than the capacity are cut, others stay
    whole. Null and empty texts are one piece of one token. Repeated rows and
    null ids are packed like any other row. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    staged = Staged(docs.sparkSession, "packing")
    pieces = staged.write(token_pieces(docs, doc_id=doc_id, text=text, capacity=capacity, end_id=end_id, keep_ids=keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_plan(histogram, capacity)

    # rank among the pieces of a length: slots keep any (length, slot) small, however many pieces share a length
    slots = max(64, sum(histogram.values()) // 8192)
    slot = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(5)), F.lit(slots)).alias("slot")
    dealt = pieces.select("*", slot)
    sizes = dealt.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "slot", F.coalesce(before, F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece"))
    ranked = dealt.join(bases, ["length", "slot"]).withColumn("rank", F.col("base") + nth - 1).drop("slot", "base")
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (column(batch, c).to_numpy() for c in ("length", "rank"))
            sequence, offset = place(plan, lengths, ranks)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names[:-2]], pa.array(sequence), pa.array(offset)], names)

    kinds = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")
