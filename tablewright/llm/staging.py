"""Staged tables: intermediate results written once to the shared folder of the cluster.

A staged table cuts lineage, survives the loss of executors and is read with
column pruning. It lives under ``spark.checkpoint.dir`` or the context's checkpoint
folder; only where neither is set and driver and executors are one machine (tests, notebooks)
a temporary folder of this machine is taken.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tablewright-"))
    return _own_dir[0]


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Keep what Spark sends a Python worker at once, on both sides, near ``BATCH_BYTES``.

    By default a batch has up to 10,000 rows, and long texts make that many megabytes in
    every buffer on its way. The session's own lower limit stays.
    """
    now = spark.conf.get(_BATCH, None)
    found = re.fullmatch(r"(-?\d+)b?", now) if now else None
    if now is None or (found and not 0 < int(found[1]) <= BATCH_BYTES):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Staged:
    """Writes DataFrames below one folder and can remove each of them again."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)  # whatever is left goes when the driver ends

    def write(self, df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.option("compression", compression).parquet(path)
        self.paths[tag] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Remove staged tables that nothing will read any more."""
        jvm = self.spark._jvm
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(tag))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def input_gigabytes(df: DataFrame, text: str | None = None) -> float:
    """Size of a plan's input: of its files if it only reads files, else measured (bytes of ``text``, or rows)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    if all(x.getClass().getSimpleName() == "LogicalRelation" for x in leaves):
        return sum(float(str(x.stats().sizeInBytes())) for x in leaves) / 1e9
    if text is None:
        return df.count() * 1e3 / 1e9
    return float(df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0) / 1e9


def buckets_for(df: DataFrame, text: str, mb_each: float, least: int) -> int:
    """Number of hash buckets so that each holds about ``mb_each`` MB of the input."""
    return max(least, int(input_gigabytes(df, text) * 1000 / mb_each) + 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each led by as many underscores as make it new to ``df`` (names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
