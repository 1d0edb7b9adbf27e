"""``python -m tablewright.cli plan MODULE:ATTRIBUTE``: what a run would change. Exit 0: planned, 1: failures, 2: wrong use."""

from __future__ import annotations

import argparse
import contextlib
import importlib
import os
import re
import sys

from .operators.declare import Table
from .operators.engine import DuplicateTable, Engine
from .plans.report import SyncReport


def load_declarations(reference: str) -> list[Table]:
    """The tables at ``MODULE:ATTRIBUTE``: a non-empty sequence of declarations."""
    module, sep, attribute = reference.partition(":")
    if not sep or not module or not attribute.isidentifier() or not all(p.isidentifier() for p in module.split(".")):
        raise ValueError("the reference must look like package.module:attribute")
    with contextlib.redirect_stdout(sys.stderr):  # imported code may print; stdout is for the plan
        found = getattr(importlib.import_module(module), attribute)
    if isinstance(found, Table):
        found = [found]
    if not isinstance(found, (list, tuple)) or not found or not all(isinstance(t, Table) for t in found):
        raise ValueError(f"{reference} is no list of tables")
    return list(found)


def redact(text: str) -> str:
    """Hide the values of environment variables whose names say that they are secret."""
    for name, value in os.environ.items():
        if value and re.search("TOKEN|SECRET|PASSWORD|PRIVATE_KEY", name):
            text = text.replace(value, "***")
    return text


def render_plan(report: SyncReport, target: str) -> str:
    sql = [f"-- {name}\n" + "\n".join(f"{s};" for s in statements) for name, statements in report.planned_sql_statements.items()]
    return "\n\n".join([f"TARGET\n======\n{target}", report.render_diff(), report.render(), "PLANNED SQL\n===========\n" + ("\n\n".join(sql) or "none")])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tablewright", description="Plan table changes without applying them.")
    commands = parser.add_subparsers(dest="command", required=True)
    planned = commands.add_parser("plan")
    planned.add_argument("declarations", metavar="MODULE:ATTRIBUTE")
    planned.add_argument("--store", help="folder of a local table store; the session's catalog if absent")
    try:
        args = parser.parse_args(argv)
        sys.path.insert(0, os.getcwd())
        tables = load_declarations(args.declarations)
        if len({t.table_id for t in tables}) < len(tables):
            raise DuplicateTable("a table is declared twice")
        from pyspark.sql import SparkSession

        from .sources.catalog import SparkCatalog
        from .sources.local_store import LocalStore

        spark = SparkSession.builder.getOrCreate()
        reader = LocalStore(spark, args.store) if args.store else SparkCatalog(spark)
        report = Engine(spark, reader).sync(*tables, dry_run=True)
    except SystemExit as e:
        return int(e.code or 0)
    except Exception as e:
        print(redact(f"{type(e).__name__}: {e}"), file=sys.stderr)
        return 2
    print(redact(render_plan(report, args.store or "session catalog")))
    return int(report.has_failures)


if __name__ == "__main__":
    sys.exit(main())
