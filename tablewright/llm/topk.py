"""Exact top-k inner products with a bit-sliced index.

Vectors become whole numbers (``floor(64 * x)``). A block of candidates is stored
as bit slices: one bitmap per dimension and bit. A query adds the slices of all
dimensions, weighted by its own bits, with bitmap full adders; the sums are again
bit slices. The best rows are then selected from the most significant slice
downward, and rows tied at the boundary are resolved by id.

Queries and candidates meet in blocks: every block of the stated query set with
every index block, both of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staged
from .textcore import column

SCALE = 64.0
_LIMIT = 2**62
_CELLS = 1 << 23  # components of a block, whatever the dimension


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = column(batch, "vector")
        lists = vectors.cast(pa.large_list(pa.float64()))
        offsets, flat = lists.offsets.to_numpy(), lists.values
        flat = flat.to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy()
        bad = ~np.isfinite(flat)  # nulls are NaN here
        wrong = np.concatenate([[0], np.cumsum(bad)])
        valid = (wrong[offsets[1:]] == wrong[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
        scaled = np.floor(np.where(bad, 0.0, flat) * SCALE)
        if np.abs(scaled).max(initial=0) >= _LIMIT:
            raise ValueError("a component of a vector is 2**56 or more")
        whole = scaled.astype("<i8")
        rows = np.flatnonzero(valid)
        out = pa.array([whole[offsets[i] : offsets[i + 1]].tobytes() for i in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([column(batch, "vec_id").take(pa.array(rows)), out], ["vec_id", "q"])


def _matrix(raws: list[bytes]) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled with zeros."""
    width = max((len(r) // 8 for r in raws), default=0)
    out = np.zeros((len(raws), width), dtype=np.int64)
    for k, raw in enumerate(raws):
        out[k, : len(raw) // 8] = np.frombuffer(raw, "<i8")
    return out


class SlicedBlock:
    """Bit slices of a block of candidates, rows ordered by id."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray):
        self.ids, self.low, self.slices = ids, low, slices  # slices: dimension, bit, word
        n, words = len(ids), slices.shape[2]
        self.valid = np.zeros(words, dtype=np.uint64)
        bits = np.zeros(words * 64, dtype=np.uint8)
        bits[:n] = 1
        self.valid[:] = np.packbits(bits, bitorder="little").view(np.uint64)
        self.flipped = ~slices

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        low = vectors.min(axis=0) if len(ids) else np.zeros(vectors.shape[1], np.int64)
        above = vectors - low
        bits = max(1, int(above.max(initial=0)).bit_length())
        words = -(-len(ids) // 64)
        slices = np.zeros((vectors.shape[1], bits, words), dtype=np.uint64)
        padded = np.zeros((words * 64, vectors.shape[1]), dtype=np.int64)
        padded[: len(ids)] = above
        for b in range(bits):
            packed = np.packbits(((padded >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            slices[:, b, :] = np.ascontiguousarray(packed).view(np.uint64)
        return SlicedBlock(ids, low, slices)

    def add(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Bit slices of the inner products, less a constant that is returned too."""
        dims = min(len(query), len(self.low))
        query = query[:dims]
        width = self.slices.shape[1]
        most = (1 << width) - 1
        # a negative factor takes the flipped slices: q * c = |q| * (most - c) - |q| * most
        whole = [int(q) for q in query]  # sums may be wider than a machine word
        constant = sum(q * int(c) for q, c in zip(whole, self.low, strict=False)) + most * sum(q for q in whole if q < 0)
        top = max(1, (most * sum(map(abs, whole))).bit_length())
        total = np.zeros((top + 1, self.slices.shape[2]), dtype=np.uint64)
        carry, spare = np.zeros_like(total), np.zeros_like(total)
        low_part = np.empty((width, self.slices.shape[2]), dtype=np.uint64)
        for d in np.flatnonzero(query):
            q = int(query[d])
            addend = self.slices[d] if q > 0 else self.flipped[d]
            q, p = abs(q), 0
            while q:
                if q & 1:
                    s, c = total[p:top], carry[p:top]
                    np.bitwise_and(s, c, out=spare[p + 1 : top + 1])
                    np.bitwise_xor(s, c, out=s)
                    np.bitwise_and(s[:width], addend, out=low_part)
                    spare[p + 1 : p + width + 1] |= low_part
                    s[:width] ^= addend
                    spare[p] = 0
                    spare[:p] = carry[:p]
                    carry, spare = spare, carry
                q >>= 1
                p += 1
        ripple = np.zeros(total.shape[1], dtype=np.uint64)
        for j in range(top):
            s, c = total[j], carry[j]
            half, both = s ^ c, s & c
            total[j] = half ^ ripple
            ripple = both | (half & ripple)
        return total[:top], constant

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows whose id is not ``own``; ties at the boundary go to smaller ids."""
        sums, constant = self.add(query)
        open_ = self.valid.copy()
        a, b = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        for row in range(a, b):
            open_[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure = np.zeros_like(open_)
        n_sure = 0
        for j in range(len(sums) - 1, -1, -1):
            ones = open_ & sums[j]
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n > k:
                open_ = ones
            else:
                sure |= ones
                n_sure += n
                open_ &= ~sums[j]
                if n_sure == k:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if n_sure < k:
            tied = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[: k - n_sure]
            rows = np.concatenate([rows, tied])
        bits = (sums[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        if len(sums) < 62 and abs(constant) < 2**62:
            return self.ids[rows], (bits.astype(np.int64) << np.arange(len(sums), dtype=np.int64)[:, None]).sum(axis=0) + constant
        wide = [sum(1 << int(j) for j in np.flatnonzero(of)) + constant for of in bits.T]
        if any(not -(2**63) <= x < 2**63 for x in wide):
            raise OverflowError(f"an inner product of vector {own} does not fit a long")
        return self.ids[rows], np.array(wide, dtype=np.int64)


def top_k(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    is_query: Column | None = None,
    k: int = 20,
    block_rows: int = 1 << 16,
    query_rows: int = 1 << 12,
    cells: int = 48,
) -> DataFrame:
    """The k largest integer inner products of every query: query_id, rank, vec_id, score.

    Queries are the rows with ``is_query`` (default: id divisible by 20);
    candidates are all rows but those with the query's id. Ties go to smaller ids;
    queries with fewer candidates get fewer rows. Null vectors, vectors with a null
    or non-finite component and null ids take no part. Vectors of unequal length
    are compared as if filled with zeros. Every repeated candidate counts; a
    repeated query id is answered once, for the row with the smallest vector
    bytes. An empty table gives an empty result. Sums are exact at any width: components of 2**56 or more, and a
    score among the ``k`` largest that no long holds, raise an error. Other columns are not read. ``block_rows``,
    ``query_rows`` and ``cells`` shape the grid and never the result; a block holds fewer rows of longer vectors.
    """
    staged = Staged(vectors.sparkSession, "topk")
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull())
    rows = staged.write(own.mapInArrow(_quantise, "vec_id long, q binary"), "rows")
    asked = (F.col("vec_id") % 20 == 0) if is_query is None else is_query
    queries = rows.where(asked).groupBy("vec_id").agg(F.min("q").alias("q"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("q")).alias("most")).first()
    n, m = size["n"], queries.count()
    block_rows = max(64, min(block_rows, _CELLS // max(1, (size["most"] or 0) // 8)))
    c_blocks = max(1, -(-n // min(block_rows, max(1 << 14, n // 64))))
    q_blocks = max(1, -(-m // min(query_rows, max(64, m * c_blocks // cells))))

    def index(group: pa.Table) -> pa.Table:
        built = SlicedBlock.build(group["vec_id"].to_numpy(), _matrix(group["q"].to_pylist()))
        return pa.table({
            "cb": group["cb"][:1], "ids": [built.ids.astype("<i8").tobytes()], "low": [built.low.astype("<i8").tobytes()],
            "bits": pa.array([built.slices.shape[1]], pa.int32()), "slices": [built.slices.tobytes()],
        })

    def ask(group: pa.Table) -> pa.Table:
        vectors = _matrix(group["q"].to_pylist())
        return pa.table({"qb": group["qb"][:1], "qids": [group["vec_id"].to_numpy().astype("<i8").tobytes()], "dims": pa.array([vectors.shape[1]], pa.int32()), "qs": [vectors.astype("<i8").tobytes()]})

    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    blocks = rows.withColumn("cb", block(c_blocks, 1)).groupBy("cb").applyInArrow(index, "cb int, ids binary, low binary, bits int, slices binary")
    asks = queries.withColumn("qb", block(q_blocks, 2)).groupBy("qb").applyInArrow(ask, "qb int, qids binary, dims int, qs binary")
    blocks = staged.write(blocks, "index").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asks = staged.write(asks, "queries").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        if left.num_rows and right.num_rows:
            ids, low, slices = (np.frombuffer(left[c][0].as_py(), t) for c, t in (("ids", "<i8"), ("low", "<i8"), ("slices", np.uint64)))
            bits = left["bits"][0].as_py()
            found = SlicedBlock(ids, low, slices.reshape(len(low), bits, -(-len(ids) // 64)))
            qids = np.frombuffer(right["qids"][0].as_py(), "<i8")
            qs = np.frombuffer(right["qs"][0].as_py(), "<i8").reshape(len(qids), right["dims"][0].as_py())
            for qid, q in zip(qids, qs, strict=True):
                best, scores = found.best(q, int(qid), k)
                for to, x in zip(out, (np.full(len(best), qid), best, scores), strict=True):
                    to.append(x)
        return pa.table({c: pa.array(np.concatenate(x), pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    near = blocks.groupBy("cb", "qb").cogroup(asks.groupBy("cb", "qb")).applyInArrow(answer, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
