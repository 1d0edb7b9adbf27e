"""SQL text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def backtick(x: Column) -> Column:
    """A quoted identifier."""
    return F.concat(F.lit("`"), F.replace(x, F.lit("`"), F.lit("``")), F.lit("`"))


def literal(x: Column) -> Column:
    """A quoted string literal."""
    doubled = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.lit("'"), doubled, F.lit("'"))


def dotted(x: Column) -> Column:
    """A qualified name, each part quoted."""
    return F.array_join(F.transform(F.split(x, r"\."), backtick), ".")


def name_list(xs: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(xs, backtick), ", "), F.lit(")"))


def pair(key: Column, value: Column) -> Column:
    return F.concat(literal(key), F.lit("="), literal(value))
