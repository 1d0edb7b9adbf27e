"""Token counts of flat, unindexed token files by a separator scan.

A flat file holds the ids of many documents one after another, each ended by a
separator id; nothing says where a document begins. Files are read as blocks of
equal size. Each block is searched for separators with one vectorised compare;
an exclusive prefix scan over the blocks of a file then stitches documents that
cross block boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import Staged
from .textcore import column
from .tokens import END_OF_DOCUMENT, encode

BLOCK_TOKENS = 1 << 16


def read_flat_files(spark: SparkSession, path: str, *, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file_id, block_no, tokens) of raw files of little-endian ids, of any size.

    Spark lists the files; executors read byte ranges of them, spread over tasks by range, so that no
    file is held whole. Paths must be local, mounted, or in a store that pyarrow opens. Empty files have one block of no
    tokens; bytes after the last whole id are not read.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "length")
    size = width * block_tokens
    n = F.greatest(F.ceil(F.col("length") / size), F.lit(1))
    blocks = files.select("file_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block_no"))
    # neighbouring blocks of a file go to one task
    tasks = max(spark.sparkContext.defaultParallelism, int(files.agg(F.sum("length")).first()[0] or 0) >> 27)
    blocks = blocks.repartitionByRange(tasks, "file_id", "block_no")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for uri, length, block in zip(*(column(batch, c).to_pylist() for c in ("file_id", "length", "block_no")), strict=True):
                if uri != name:
                    if file is not None:
                        file.close()
                    name, file = uri, _open(uri)
                file.seek(block * size)
                raw = file.read(min(size, max(length - block * size, 0)))
                row = [[uri], [block], [raw[: len(raw) // width * width]]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.string(), pa.int64(), pa.binary()], strict=True)], ["file_id", "block_no", "tokens"])

    return blocks.mapInArrow(read, "file_id string, block_no long, tokens binary")


def _open(uri: str):
    if uri.startswith("file:"):
        return open(unquote(urlsplit(uri).path), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def flat_blocks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", separator: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write documents as flat token streams, one per task, cut into blocks.

    Returns file_id, block_no, tokens (uint16) and doc_ids, the ids of the
    documents that end in the block: a manifest beside the stream, which the scan
    does not read.
    """
    names = ["file_id", "block_no", "tokens", "doc_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        size, position = 0, 0
        ended: list[tuple[int, int | None]] = []  # token position of the separator, doc_id

        def emit(stream: np.ndarray) -> pa.RecordBatch:
            upto = block * block_tokens + len(stream)
            mine = [d for at, d in ended if at < upto]
            del ended[: len(mine)]
            row = [[file], [block], [stream.astype("<u2").tobytes()], [mine]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())], strict=True)], names)

        for batch in batches:
            for key, body in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                ids = np.append(encode(body.as_py()), np.uint32(separator)).astype(np.uint16)
                position += len(ids)
                ended.append((position - 1, key))
                held.append(ids)
                size += len(ids)
                if size >= block_tokens:
                    stream = np.concatenate(held)
                    while len(stream) >= block_tokens:
                        yield emit(stream[:block_tokens])
                        block, stream = block + 1, stream[block_tokens:]
                    held, size = [stream], len(stream)
        if size:
            yield emit(np.concatenate(held))

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "file_id int, block_no long, tokens binary, doc_ids array<bigint>")


def count_tokens(blocks: DataFrame, *, separator: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """Documents of flat token files: file_id, doc_index, start, n_tokens, terminated.

    ``blocks`` has file_id, block_no and tokens; other columns are not read. n_tokens
    leaves the separator out. Tokens after a file's last separator are a last
    document with ``terminated`` false; nothing follows a separator at the very
    end of a file. Empty or null blocks hold no token; two separators in a row
    are a document of no tokens.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    file_type = dict(blocks.dtypes)["file_id"]
    names = ["file_id", "block_no", "n", "seps"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for raw in column(batch, "tokens"):
                ids = np.frombuffer(raw.as_buffer() if raw.is_valid else b"", dtype=kind)
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays([column(batch, "file_id"), column(batch, "block_no"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names)

    own = blocks.select("file_id", F.col("block_no").cast("long").alias("block_no"), "tokens")
    found = own.mapInArrow(scan, f"file_id {file_type}, block_no long, n long, seps array<bigint>")
    order = Window.partitionBy("file_id").orderBy("block_no")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    found = found.withColumns({"begin": F.coalesce(F.sum("n").over(earlier), none), "docs": F.coalesce(F.sum(F.size("seps")).over(earlier), none)})
    after_last = F.col("begin") + F.try_element_at("seps", F.lit(-1)) + 1
    found = found.withColumns({
        "open_from": F.coalesce(F.max(after_last).over(earlier), none),
        "is_last": F.lead("block_no").over(order).isNull(),
    })
    # documents that end here; the first may have begun blocks ago
    span = lambda start, end, done: F.struct(start.alias("start"), end.alias("end"), F.lit(done).alias("terminated"))
    start_of = lambda i: F.when(i == 0, F.col("open_from")).otherwise(F.col("begin") + F.get("seps", i - 1) + 1)
    ending = F.transform("seps", lambda x, i: span(start_of(i), F.col("begin") + x, True))
    end = F.col("begin") + F.col("n")
    tail_from = F.coalesce(after_last, F.col("open_from"))
    unended = F.filter(F.array(span(tail_from, end, False)), lambda x: F.col("is_last") & (x["end"] > x["start"]))
    rows = found.select("file_id", "docs", F.posexplode(F.concat(ending, unended)).alias("k", "of"))
    return rows.select(
        "file_id", (F.col("docs") + F.col("k")).alias("doc_index"), F.col("of.start").alias("start"),
        (F.col("of.end") - F.col("of.start")).alias("n_tokens"), F.col("of.terminated").alias("terminated"))


def document_token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of a table's documents through flat files: doc_id, file_id, doc_index, start, n_tokens.

    Null and empty texts count 0 tokens; null ids and repeated rows keep one row
    each. Which documents share a file follows the input's partitions.
    """
    staged = Staged(docs.sparkSession, "token-counts")
    blocks = staged.write(flat_blocks(docs, doc_id=doc_id, text=text, block_tokens=block_tokens), "flat")
    counts = count_tokens(blocks)
    order = Window.partitionBy("file_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    manifest = blocks.select("file_id", "block_no", "doc_ids", F.size("doc_ids").alias("n"))
    manifest = manifest.select("file_id", "doc_ids", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("docs"))
    manifest = manifest.select("file_id", "docs", F.posexplode("doc_ids").alias("k", "doc_id"))
    manifest = manifest.select("file_id", (F.col("docs") + F.col("k")).alias("doc_index"), "doc_id")
    return counts.join(manifest, ["file_id", "doc_index"]).select("doc_id", "file_id", "doc_index", "start", "n_tokens")
