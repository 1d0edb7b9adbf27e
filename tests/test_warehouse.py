"""A warehouse behind a DB-API connection, over a fake cursor; errors that cannot describe themselves."""

import json

import pytest

from tablewright import Engine, ReadError, SyncFailed
from tablewright.errors import condition, exception_message, exception_name
from tablewright.estate_queries import _INFORMATION, DOCUMENT
from tablewright.schema import Column, Integer, Table
from tablewright.sources.warehouse import WarehouseCatalog


class Missing(Exception):
    pass


class Cursor:
    def __init__(self, connection):
        self.connection, self.rows = connection, []

    def execute(self, statement):
        self.connection.log.append((id(self), statement))
        if statement.startswith("DESCRIBE"):
            name = statement.split()[3]
            if name not in self.connection.documents:
                raise Missing("[TABLE_OR_VIEW_NOT_FOUND] no such table")
            self.rows = [(self.connection.documents[name],)]
        elif "information_schema" in statement:
            columns = statement[len("SELECT ") : statement.index(" FROM")].split(", ")
            names, rows = _INFORMATION[statement.rsplit(".", 1)[1]]
            self.rows = [tuple(r[names.index(c)] for c in columns) for r in rows]
        elif "bad" in statement:
            raise RuntimeError("refused")

    def fetchall(self):
        return self.rows

    def close(self):
        self.connection.closed += 1
        raise OSError("already gone")


class Connection:
    def __init__(self, documents, broken=False):
        self.documents, self.log, self.closed, self.opened, self.broken = documents, [], 0, 0, broken

    def cursor(self):
        if self.broken:
            raise ConnectionError("no route")
        self.opened += 1
        return Cursor(self)


def test_reads_share_a_cursor(spark):
    connection = Connection({"`lake`.`c`.`t`": json.dumps(DOCUMENT)})
    found = WarehouseCatalog(spark, connection).read(["lake.c.t", "lake.c.gone", "lake.nowhere.t"])
    state = found["lake.c.t"]
    assert state.primary_key == ("t_pk", ["a", "b"]) and state.tags == {"owner": "me"} and state.inbound == [("u_fk", "lake.c.u")]
    assert found["lake.c.gone"] is None and isinstance(found["lake.nowhere.t"], ReadError)
    assert connection.opened == connection.closed == 1
    assert sum("information_schema" in s for _, s in connection.log) == 6  # each relation once, whatever the number of tables


def test_a_dead_connection_is_each_tables_read_error(spark):
    found = WarehouseCatalog(spark, Connection({}, broken=True)).read(["lake.c.t", "lake.c.u"])
    assert {type(x) for x in found.values()} == {ReadError} and found["lake.c.t"].exception_type == "ConnectionError"


def test_statements_get_cursors_of_their_own(spark):
    connection = Connection({})
    catalog = WarehouseCatalog(spark, connection)
    table = Table("lake", "c", "fresh", [Column("id", Integer())], tags={"a": "b", "c": "bad"})
    with pytest.raises(SyncFailed) as failed:
        Engine(spark, catalog, catalog).sync(table)
    run = failed.value.report.tables[0]
    assert run.applied == 2 and run.failures[0].extra["statement_index"] == 2 and run.failures[0].extra["exception_type"] == "RuntimeError"
    written = [c for c, s in connection.log if not s.startswith(("DESCRIBE", "SELECT"))]
    assert len(written) == 3 and connection.opened == connection.closed == 4


def test_errors_that_cannot_speak():
    class Gone(Exception):
        java_exception = property(lambda self: (_ for _ in ()).throw(ConnectionError("gateway")))

        def __str__(self):
            raise ConnectionError("gateway")

        def getCondition(self):  # noqa: N802
            raise ConnectionError("gateway")

    assert exception_name(Gone()) == "Gone" and "no readable message" in exception_message(Gone()) and condition(Gone()) is None
    assert condition(Exception("  [A.B_1] text")) == "A.B_1" and condition(Exception("text [A]")) is None
