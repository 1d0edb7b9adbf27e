"""A Spark session's catalog as source of state and sink of statements."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import condition, exception_message, exception_name
from ..functions.types import quote_name
from ..operators.declare import BoundKey, Table
from ..operators.engine import ReadError
from ..operators.relations import Observed
from . import information_schema as info
from .describe import MetadataError, parse_description

SUBSTITUTE = "spark.sql.variable.substitute"


def run_statement(spark: SparkSession, statement: str) -> DataFrame:
    """Run SQL as written: variable substitution, which reaches into quoted text, is off while it matters."""
    if "${" not in statement:
        return spark.sql(statement)
    before = spark.conf.get(SUBSTITUTE)
    if before.lower() == "false":
        return spark.sql(statement)
    spark.conf.set(SUBSTITUTE, "false")
    try:
        return spark.sql(statement)
    finally:
        spark.conf.set(SUBSTITUTE, before)


class SparkCatalog:
    """Reads with one description per table and, for all tables of a catalog together, one scan per kind of key or tag.

    ``relations`` gives the ``information_schema`` relations of a catalog as DataFrames
    (schemata, table_constraints, key_column_usage, referential_constraints, table_tags, column_tags), or None where
    there are none. ``providers`` are the table formats that are managed. Statements are executed one by one.
    """

    def __init__(self, spark: SparkSession, relations=None, providers: tuple[str, ...] = ("delta",)):
        self.spark, self.relations, self.providers = spark, relations, providers

    def describe(self, name: str) -> str | None:
        """The JSON description of a table."""
        rows = run_statement(self.spark, f"DESCRIBE TABLE EXTENDED {name} AS JSON").collect()
        return rows[0][0] if rows else None

    def execute(self, table: Table, action: dict) -> None:
        run_statement(self.spark, action["statement"])

    def read(self, table_ids: list[str]) -> dict[str, Observed | ReadError | None]:
        described = {t: self._described(t) for t in table_ids}
        found: dict[str, Observed | ReadError | None] = {}
        attached: dict[str, dict | ReadError] = {}
        for catalog in {t.split(".")[0] for t, text in described.items() if isinstance(text, str)}:
            mine = [t for t, text in described.items() if isinstance(text, str) and t.split(".")[0] == catalog]
            try:
                attached |= self._attached(catalog, mine)
            except Exception as e:  # the boundary: one catalog's scans concern its tables only
                attached |= dict.fromkeys(mine, ReadError(exception_name(e), exception_message(e)))
        for t, text in described.items():
            found[t] = text
            if isinstance(text, str):
                more = attached[t]
                try:
                    found[t] = more if isinstance(more, ReadError) else parse_description(text, t, self.providers, **more)
                except Exception as e:
                    found[t] = ReadError(exception_name(e), exception_message(e))
        return found

    def _described(self, table_id: str) -> str | ReadError | None:
        try:
            text = self._present(table_id)
            if text == "":
                raise MetadataError("the description is empty")
            return text
        except Exception as e:  # the boundary: one table's read error is that table's failure
            return ReadError(exception_name(e), exception_message(e))

    def _present(self, table_id: str) -> str | None:
        catalog, schema, table = table_id.split(".")
        try:
            return self.describe(".".join(map(quote_name, (catalog, schema, table)))) or ""
        except Exception as e:
            if condition(e) != "TABLE_OR_VIEW_NOT_FOUND":
                raise
            if self._schema_exists(catalog, schema):
                return None
            raise MetadataError(f"schema {catalog}.{schema} does not exist") from e

    def _schema_exists(self, catalog: str, schema: str) -> bool:
        found = self.relations(catalog) if self.relations else None
        if found is not None:
            return bool(info.schema_exists(found["schemata"], schema).collect())
        return bool(self.spark.sql(f"SHOW SCHEMAS IN {quote_name(catalog)}").where(F.lower(F.col("namespace")) == schema).limit(1).collect())

    def _attached(self, catalog: str, table_ids: list[str]) -> dict[str, dict]:
        """Keys and tags of all tables of a catalog, in one job."""
        r = self.relations(catalog) if self.relations else None
        out: dict[str, dict] = {t: {} for t in table_ids}
        if r is None:
            return out
        rows = defaultdict(list)
        for row in info.attached(r, table_ids).orderBy("table_id", "kind", "name", "ord").collect():
            rows[row["table_id"], row["kind"]].append(row)
        for t in table_ids:
            tags: dict[str, dict[str, str]] = defaultdict(dict)
            for x in rows[t, "column_tag"]:
                tags[x["a"].lower()][x["name"]] = x["b"]
            keys = defaultdict(list)
            for x in rows[t, "foreign_key"]:
                keys[x["name"]].append(x)
            primary = rows[t, "primary_key"]
            out[t] = {
                "column_tags": dict(tags), "tags": {x["name"]: x["b"] for x in rows[t, "table_tag"]},
                "primary_key": (primary[0]["name"], [x["a"] for x in primary]) if primary else None,
                "foreign_keys": [BoundKey(tuple(x["a"] for x in xs), xs[0]["other"], tuple(x["b"] for x in xs), name) for name, xs in keys.items()],
                "inbound": sorted(((x["name"], x["other"]) for x in rows[t, "inbound"]), key=lambda x: (x[1], x[0])),
            }
        return out
