"""A SQL warehouse behind a DB-API connection as source of state and sink of statements.

Nothing here knows a vendor: ``connection`` is anything with ``cursor()``. Reads share one cursor that is
opened with the first query; every statement that changes something gets a cursor of its own. Errors on closing a
cursor are logged and never replace the outcome.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..functions.types import quote_name
from ..operators.declare import Table
from ..operators.engine import ReadError
from ..operators.relations import Observed
from .catalog import SparkCatalog

logger = logging.getLogger(__name__)

# The columns of the information_schema relations that are read.
_CONSTRAINT = ("constraint_catalog", "constraint_schema", "constraint_name")
_COLUMNS = {
    "schemata": ("schema_name",),
    "table_constraints": (*_CONSTRAINT, "table_catalog", "table_schema", "table_name", "constraint_type"),
    "key_column_usage": (*_CONSTRAINT, "table_catalog", "table_schema", "table_name", "column_name", "ordinal_position", "position_in_unique_constraint"),
    "referential_constraints": (*_CONSTRAINT, "unique_constraint_catalog", "unique_constraint_schema", "unique_constraint_name"),
    "table_tags": ("catalog_name", "schema_name", "table_name", "tag_name", "tag_value"),
    "column_tags": ("catalog_name", "schema_name", "table_name", "column_name", "tag_name", "tag_value"),
}
_WHOLE = ("ordinal_position", "position_in_unique_constraint")


class Cursors:
    """Cursors of a connection, opened late and closed quietly."""

    def __init__(self, connection):
        self.connection, self.current = connection, None

    @contextmanager
    def shared(self) -> Iterator[None]:
        """One cursor for all queries within."""
        try:
            yield
        finally:
            self._close(self.current)
            self.current = None

    def query(self, statement: str) -> list:
        if self.current is None:
            self.current = self.connection.cursor()
        self.current.execute(statement)
        return list(self.current.fetchall())

    def run(self, statement: str) -> None:
        cursor = None
        try:
            cursor = self.connection.cursor()
            cursor.execute(statement)
        finally:
            self._close(cursor)

    @staticmethod
    def _close(cursor) -> None:
        if cursor is not None:
            try:
                cursor.close()
            except Exception:
                logger.debug("a cursor did not close", exc_info=True)


class WarehouseCatalog(SparkCatalog):
    """Reader and executor over a DB-API connection; the session only relates what was read."""

    def __init__(self, spark: SparkSession, connection, providers: tuple[str, ...] = ("delta",)):
        super().__init__(spark, self._relations, providers)
        self.cursors, self._seen = Cursors(connection), {}

    def read(self, table_ids: list[str]) -> dict[str, Observed | ReadError | None]:
        self._seen = {}
        with self.cursors.shared():
            return super().read(table_ids)

    def describe(self, name: str) -> str | None:
        rows = self.cursors.query(f"DESCRIBE TABLE EXTENDED {name} AS JSON")
        return rows[0][0] if rows else None

    def execute(self, table: Table, action: dict) -> None:
        self.cursors.run(action["statement"])

    def _relations(self, catalog: str) -> dict:
        """Each relation of a catalog, fetched once per read."""
        if catalog not in self._seen:
            self._seen[catalog] = {
                name: self.spark.createDataFrame(
                    [tuple(r) for r in self.cursors.query(f"SELECT {', '.join(columns)} FROM {quote_name(catalog)}.information_schema.{name}")],
                    ", ".join(f"{c} {'long' if c in _WHOLE else 'string'}" for c in columns))
                for name, columns in _COLUMNS.items()}
        return self._seen[catalog]
