"""Declarative table reconciliation on Spark, with relational catalog state."""

from .operators.declare import SELF, Column, ForeignKey, Table
from .operators.engine import DuplicateTable, Engine, ReadError, SyncFailed
from .plans.report import (
    ExecutionFailure,
    Failure,
    FailurePhase,
    ForeignKeyFailure,
    ReadFailure,
    SyncReport,
    TableChangeState,
    TableRun,
    TableRunStatus,
    ValidationFailure,
    render_diff,
    render_report,
)

__all__ = [
    "SELF", "Column", "DuplicateTable", "Engine", "ExecutionFailure", "Failure", "FailurePhase", "ForeignKey", "ForeignKeyFailure", "ReadError", "ReadFailure", "SyncFailed",
    "SyncReport", "Table", "TableChangeState", "TableRun", "TableRunStatus", "ValidationFailure", "render_diff", "render_report",
]
