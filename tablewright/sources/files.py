"""State of tables that are plain files, and a folder to work in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..operators.relations import Observed, ObservedColumn

_own: list[str] = []


def observed_parquet(spark: SparkSession, path: str, table_id: str, **seed) -> Observed:
    """Columns as the files have them; ``seed`` gives what files cannot hold (keys, comments, tags, properties).

    ``required`` names columns known to be not null; ``comments`` maps columns to comments.
    """
    required, comments = seed.pop("required", ()), seed.pop("comments", {})
    schema = spark.read.parquet(path).schema
    columns = [ObservedColumn(f.name, f.dataType, f.name not in required, comments.get(f.name, "")) for f in schema.fields]
    return Observed(table_id, columns, **seed)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; of this machine only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tablewright-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
