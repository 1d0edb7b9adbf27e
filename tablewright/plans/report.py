"""What a run found and did: records, wire form, text, and a DataFrame."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Phases by precedence, categories in display order with their nouns, operations.
PHASES = {"FOREIGN_KEY": 1, "READ": 2, "PLANNING": 3, "EXECUTION": 4}
CATEGORIES = {
    "columns": ("column", "columns"), "keys": ("key", "keys"), "clustering": ("clustering", "clustering"), "partitioning": ("partitioning", "partitioning"),
    "features": ("table feature", "table features"), "properties": ("property", "properties"), "tags": ("tag", "tags"), "comments": ("comment", "comments"),
}
SYMBOLS = {"add": "+", "remove": "-", "change": "~"}


@dataclass(frozen=True)
class Failure:
    phase: str
    type: str
    message: str
    extra: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"phase": self.phase, "type": self.type, "message": self.message, **self.extra}


class _OfPhase(Failure):
    """A failure whose phase and type name follow from its class."""

    PHASE = ""

    def __init__(self, message: str, **extra):
        super().__init__(self.PHASE, type(self).__name__, message, extra)


class ForeignKeyFailure(_OfPhase):
    PHASE = "FOREIGN_KEY"


class ReadFailure(_OfPhase):
    PHASE = "READ"


class ValidationFailure(_OfPhase):
    PHASE = "PLANNING"


class ExecutionFailure(_OfPhase):
    PHASE = "EXECUTION"


class FailurePhase(StrEnum):
    FOREIGN_KEY = "FOREIGN_KEY"
    READ = "READ"
    PLANNING = "PLANNING"
    EXECUTION = "EXECUTION"


class TableRunStatus(StrEnum):
    SUCCESS = "SUCCESS"
    FOREIGN_KEY_FAILED = "FOREIGN_KEY_FAILED"
    READ_FAILED = "READ_FAILED"
    PLANNING_FAILED = "PLANNING_FAILED"
    EXECUTION_FAILED = "EXECUTION_FAILED"


class TableChangeState(StrEnum):
    UNCHANGED = "unchanged"
    NOT_PLANNED = "not planned"
    PLANNED = "planned"
    NOT_APPLIED = "not applied"
    PARTIALLY_APPLIED = "partially applied"
    APPLIED = "applied"


def render_report(report: SyncReport) -> str:
    """The status grid, failures and footer as text."""
    return report.render()


def render_diff(report: SyncReport) -> str:
    """Every table's changes as text."""
    return report.render_diff()


def difference_lines(row: dict, table) -> list[str]:
    """One difference as the diff view states it."""
    return [f"{SYMBOLS[o]} {s} {d}".rstrip() for _, o, s, d in change_entries(row, table)]


def head(message: str, lines: int = 5) -> str:
    return "\n".join(message.split("\n")[:lines])


def _quoted(text: str) -> str:
    return f"'{text}'" if text else "(unset)"


def _listed(names) -> str:
    return "(" + ", ".join(names) + ")"


def _set(row: dict) -> tuple[str, str]:
    if row["old"] is None:
        return "add", f"= '{row['value']}'"
    return "change", f"= '{row['value']}' (was '{row['old']}')"


def change_entries(row: dict, table) -> list[tuple[str, str, str, str]]:
    """(category, operation, subject, detail) lines of one difference."""
    a, typed = row["action"], lambda display, nullable: display if nullable else f"{display} NOT NULL"
    match a:
        case "CreateTable":
            from ..functions.types import display

            out = [("columns", "add", c.name, typed(display(c.type), c.nullable)) for c in table.columns]
            if table.primary_key:
                out.append(("keys", "add", f"primary key {table.primary_key_name or _listed(table.primary_key)}", _listed(table.primary_key)))
            if table.clustered_by:
                out.append(("clustering", "add", "clustering", _listed(table.clustered_by)))
            if table.partitioned_by:
                out.append(("partitioning", "add", "partitioning", _listed(table.partitioned_by)))
            out += [("properties", "add", k, f"= '{v}'") for k, v in sorted(table.properties.items()) if v is not None]
            out += [("comments", "add", f"column {c.name}", _quoted(c.comment)) for c in table.columns if c.comment]
            return out + ([("comments", "add", "table", _quoted(table.comment))] if table.comment else [])
        case "AddColumn":
            comment = [("comments", "add", f"column {row['col']}", _quoted(row["comment"]))] if row["comment"] else []
            return [("columns", "add", row["col"], typed(row["display"], row["nullable"])), *comment]
        case "DropColumn":
            return [("columns", "remove", row["col"], "")]
        case "RenameColumn":
            return [("columns", "change", row["col"], f"renamed → {row['new']}")]
        case "SetColumnNullability":
            return [("columns", "change", row["col"], "drop NOT NULL (was NOT NULL)" if row["nullable"] else "set NOT NULL (was nullable)")]
        case "AlterColumnType":
            return [("columns", "change", row["col"], f"{row['old_display']} → {row['display']}")]
        case "SetColumnComment":
            return [("comments", "change", f"column {row['col']}", _quoted(row["comment"]))]
        case "SetTableComment":
            return [("comments", "change", "table", _quoted(row["comment"]))]
        case "EnableTableFeature":
            return [("features", "add", row["key"], "— permanent protocol upgrade")]
        case "SetProperty":
            operation, detail = _set(row)
            return [("properties", operation, row["key"], detail)]
        case "UnsetProperty":
            return [("properties", "remove", row["key"], "")]
        case "SetTableTag":
            operation, detail = _set(row)
            return [("tags", operation, row["tag"], detail)]
        case "UnsetTableTag":
            return [("tags", "remove", row["tag"], "")]
        case "SetColumnTag":
            operation, detail = _set(row)
            return [("tags", operation, f"column {row['col']}.{row['tag']}", detail)]
        case "UnsetColumnTag":
            return [("tags", "remove", f"column {row['col']}.{row['tag']}", "")]
        case "SetPrimaryKey":
            return [("keys", "add", f"primary key {row['name'] or _listed(row['cols'])}", _listed(row["cols"]))]
        case "DropPrimaryKey":
            return [("keys", "remove", f"primary key {row['name'] or ''}".rstrip(), "")]
        case "SetForeignKey":
            return [("keys", "add", f"foreign key {row['name'] or _listed(row['cols'])}", f"{_listed(row['cols'])} → {row['parent']}")]
        case "DropForeignKey":
            return [("keys", "remove", f"foreign key {row['name']}", "")]
        case "AlterClustering":
            if not row["cols"]:
                return [("clustering", "remove", "clustering", "")]
            return [("clustering", "change", "clustering", f"{_listed(row['cols'])}; rewrite the table to recluster existing rows")]
        case "ColumnCaseDrift":
            return [("columns", "change", row["col"], f"spelled '{row['old']}' in the catalog")]
        case "ColumnRenameConflict":
            return [("columns", "change", row["col"], f"renamed to {row['new']}, but both columns exist")]
        case "PropertyUndeclared":
            return [("properties", "change", row["key"], f"= '{row['old']}' (set on the table, undeclared)")]
        case "PartitioningChanged":
            return [("partitioning", "change", "partitioning", f"{_listed(row['old_cols'])} → {_listed(row['cols'])}")]
    raise ValueError(a)


@dataclass
class TableRun:
    """One table's part of a run. ``applied`` is None where nothing was executed."""

    name: str
    entries: list[tuple[str, str, str, str]] = field(default_factory=list)
    rejected: list[tuple[str, str, str, str]] = field(default_factory=list)
    statements: list[str] = field(default_factory=list)
    failures: list[Failure] = field(default_factory=list)
    applied: int | None = None
    creates: bool = False

    @property
    def status(self) -> str:
        if not self.failures:
            return "SUCCESS"
        return min((f.phase for f in self.failures), key=PHASES.__getitem__) + "_FAILED"

    @property
    def has_failures(self) -> bool:
        return bool(self.failures)

    @property
    def has_changes(self) -> bool:
        return bool(self.statements)

    @property
    def bucket(self) -> str:
        return "failed" if self.failures else "changed" if self.statements else "unchanged"

    def change_state(self, dry_run: bool) -> str:
        if not self.statements:
            return "not planned" if self.failures else "unchanged"
        if dry_run:
            return "planned"
        if not self.applied:
            return "not applied"
        return "applied" if self.applied == len(self.statements) else "partially applied"

    def to_dict(self) -> dict:
        record = lambda e: dict(zip(("kind", "operation", "subject", "detail"), e, strict=True))
        return {
            "name": self.name, "status": self.status, "has_changes": self.has_changes, "has_failures": self.has_failures,
            "changes": [record(e) for e in self.entries], "rejected_changes": [record(e) for e in self.rejected],
            "planned_sql_statements": list(self.statements), "failures": [f.to_dict() for f in self.failures],
            "execution": None if self.applied is None else {"applied": self.applied, "total": len(self.statements)},
        }


@dataclass
class SyncReport:
    tables: list[TableRun]
    dry_run: bool
    started_at: datetime
    ended_at: datetime

    @property
    def has_failures(self) -> bool:
        return any(t.has_failures for t in self.tables)

    @property
    def has_changes(self) -> bool:
        return any(t.has_changes for t in self.tables)

    @property
    def counts(self) -> dict[str, int]:
        """Tables per outcome; each table is in one bucket, a failed one in ``failed``."""
        found = Counter(t.bucket for t in self.tables)
        return {k: found[k] for k in ("changed", "unchanged", "failed")}

    @property
    def planned_sql_statements(self) -> dict[str, list[str]]:
        return {t.name: t.statements for t in self.tables if t.statements}

    @property
    def failures_by_table(self) -> dict[str, list[Failure]]:
        return {t.name: t.failures for t in self.tables if t.failures}

    def to_dict(self) -> dict:
        return {
            "schema_version": 2, "started_at": self.started_at.isoformat(), "ended_at": self.ended_at.isoformat(), "dry_run": self.dry_run,
            "has_changes": self.has_changes, "has_failures": self.has_failures, "tables": [t.to_dict() for t in self.tables],
        }

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """One row per table, in run order."""
        rows = [(i, t.name, t.status, t.change_state(self.dry_run), len(t.statements), t.applied, len(t.failures)) for i, t in enumerate(self.tables)]
        return spark.createDataFrame(rows, T.StructType.fromDDL("ord int, table_id string, status string, change_state string, planned int, applied int, failures int"))

    def render(self) -> str:
        grid = [("TABLE", "STATUS", "STATEMENTS", "DETAIL"), *[(t.name, t.status, self._progress(t), _detail(t)) for t in self.tables]]
        out = ["SYNC REPORT", "===========", ""]
        if self.dry_run:
            out += ["PLAN — no planned SQL executed", ""]
        out += _aligned(grid)
        if self.has_failures:
            out += ["", "FAILURES"]
            for t in self.tables:
                out += [f"  {t.name}: [{f.phase}] {line}" if not i else f"    {line}" for f in t.failures for i, line in enumerate(head(f.message).split("\n"))]
        return "\n".join([*out, "", self._footer()])

    def _progress(self, t: TableRun) -> str:
        if not t.statements:
            return "-"
        return str(len(t.statements)) if self.dry_run or t.applied is None else f"{t.applied}/{len(t.statements)}"

    def _footer(self) -> str:
        n, seconds = len(self.tables), (self.ended_at - self.started_at).total_seconds()
        if self.dry_run:
            parts = [f"{v} {k}" for k, v in self.counts.items()]
        else:
            states = Counter("failed" if t.failures and not t.applied else t.change_state(False) for t in self.tables)
            parts = [f"{v} {k}" for k, v in states.items()]
        return f"{n} table{'s' * (n != 1)}: {', '.join(parts) or 'nothing to do'} ({seconds:.1f}s)"

    def render_diff(self) -> str:
        out = ["DIFF", "===="]
        for t in self.tables:
            lines, note = (t.entries, "") if not t.rejected else (t.rejected, "  (REJECTED)")
            if t.creates and not t.rejected:
                note = "  (CREATE)"
            if not self.dry_run and t.statements and t.change_state(False) != "applied":
                state = t.change_state(False)
                note += f"  ({state}{f' {t.applied}/{len(t.statements)}' if state.startswith('partially') else ''})"
            out += ["", t.name + note]
            if not lines:
                out.append("  see failures" if t.failures else "  no changes")
            for category in CATEGORIES:
                rows = [(f"{SYMBOLS[o]} {s}", d) for c, o, s, d in lines if c == category]
                if rows:
                    out += [f"  {category}", *[f"    {x}" for x in _aligned(rows)]]
        return "\n".join(out)


def _detail(t: TableRun) -> str:
    if t.failures:
        text = t.failures[0].message.split("\n")[0]
        return text if len(text) <= 60 else text[:59] + "…"
    counts = Counter(e[0] for e in t.entries)
    return ", ".join(f"{counts[c]} {nouns[counts[c] != 1]}" for c, nouns in CATEGORIES.items() if counts[c]) or "no changes"


def _aligned(rows: list[tuple[str, ...]]) -> list[str]:
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows]
