"""Declarations of tables: immutable, checked when they are made, before any catalog is touched."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import types as T

from ..functions import types as kinds

# The aspects of a table, in display order, and the narrowest scope that manages each.
SCOPES = {"tags": 1, "annotations": 2, "metadata": 3, "full": 4}
MINIMUM_SCOPE = {
    "TABLE_EXISTENCE": 4, "COLUMN_STRUCTURE": 4, "COLUMN_COMMENTS": 2, "COLUMN_TAGS": 1, "TABLE_COMMENT": 2, "TABLE_TAGS": 1,
    "PROPERTIES": 4, "PARTITIONING": 4, "PRIMARY_KEY": 3, "FOREIGN_KEYS": 3, "CLUSTERING": 4,
}
MAPPING, FEED, WIDENING = "delta.columnMapping.mode", "delta.enableChangeDataFeed", "delta.enableTypeWidening"
_BOOLEAN, _INTERVAL = r"true|false", r"interval [0-9]+ (?:nanosecond|microsecond|millisecond|second|minute|hour|day|week)s?"
PROPERTIES = {
    MAPPING: r"none|name",
    FEED: _BOOLEAN,
    "delta.deletedFileRetentionDuration": _INTERVAL,
    "delta.logRetentionDuration": _INTERVAL,
    "delta.dataSkippingNumIndexedCols": r"-1|0|[1-9][0-9]*",
    WIDENING: _BOOLEAN,
}
class Property(StrEnum):
    """The table properties that declarations manage."""

    COLUMN_MAPPING_MODE = MAPPING
    CHANGE_DATA_FEED = FEED
    DELETED_FILE_RETENTION = "delta.deletedFileRetentionDuration"
    LOG_RETENTION = "delta.logRetentionDuration"
    DATA_SKIPPING_COLUMNS = "delta.dataSkippingNumIndexedCols"
    TYPE_WIDENING = WIDENING


#: Keys whose value may only change as listed; a removal is a change to None.
TRANSITIONS = {MAPPING: {("none", "name")}}
_RESERVED = ("_change_type", "_commit_version", "_commit_timestamp")
_SPECIAL = set(" ,;{}()\n\t=")
SELF = "self"


def may_change(key: str, old: str | None, new: str | None) -> bool:
    """Whether a property may go from ``old`` to ``new`` (None: absent)."""
    return old is None or old == new or key not in TRANSITIONS or (old, new) in TRANSITIONS[key]


def _names(value: object, what: str) -> tuple[str, ...]:
    if isinstance(value, str) or not isinstance(value, Sequence):
        raise TypeError(f"{what} takes a list of column names")
    if not all(isinstance(v, str) for v in value):
        raise TypeError(f"{what} takes column names as text")
    return tuple(value)


def _unique(names: Sequence[str], what: str) -> None:
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"{what}: a column is named twice")


def _check_tags(tags: Mapping[str, str], where: str) -> dict[str, str]:
    if len(tags) > 50:
        raise ValueError(f"{where} has more than 50 tags")
    for key, value in tags.items():
        if not isinstance(key, str) or not isinstance(value, str):
            raise TypeError(f"tags of {where} are text")
        if not key.strip() or len(key) > 256 or len(value) > 256:
            raise ValueError(f"a tag of {where} is blank or longer than 256 characters")
    return dict(tags)


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    nullable: bool = True
    comment: str = ""
    tags: Mapping[str, str] = field(default_factory=dict)
    renamed_from: str | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name.strip():
            raise ValueError("a column needs a name")
        if not isinstance(self.type, T.DataType):
            raise TypeError(f"column {self.name}: the type must be a Spark data type")
        kinds.check(self.type)
        if self.renamed_from is not None and (not self.renamed_from.strip() or self.renamed_from.lower() == self.name.lower()):
            raise ValueError(f"column {self.name} cannot be renamed from itself")
        object.__setattr__(self, "tags", _check_tags(self.tags, f"column {self.name}"))


@dataclass(frozen=True)
class ForeignKey:
    """Local columns (one name, a list, or a mapping to the parent's names) and the parent: a table or ``SELF``."""

    columns: str | Sequence[str] | Mapping[str, str]
    references: object
    name: str | None = None


@dataclass(frozen=True)
class BoundKey:
    """A foreign key with pairs ordered by local column."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    name: str | None = None


def _special_names(name: str, kind: T.DataType) -> list[str]:
    found = [name] if _SPECIAL & set(name) else []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            found += [f"{name}.{x}" for x in _special_names(f.name, f.dataType)]
    elif isinstance(kind, T.ArrayType):
        found += [f"{name}.element.{x}" for x in _special_names("", kind.elementType) if x]
    elif isinstance(kind, T.MapType):
        found += [f"{name}.{p}.{x}" for p, k in (("key", kind.keyType), ("value", kind.valueType)) for x in _special_names("", k) if x]
    return found


def _nested_not_null(kind: T.DataType, solid: bool) -> bool:
    """Whether a required field sits below a container that may be null or is an array or map."""
    if isinstance(kind, T.StructType):
        return any((not f.nullable and not solid) or _nested_not_null(f.dataType, solid and not f.nullable) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _nested_not_null(kind.elementType, False)
    if isinstance(kind, T.MapType):
        return _nested_not_null(kind.keyType, False) or _nested_not_null(kind.valueType, False)
    return False


class Table:
    """The intended state of one table."""

    def __init__(
        self, catalog: str, schema: str, name: str, columns: Sequence[Column], *, comment: str = "", properties: Mapping[str, str | None] | None = None,
        tags: Mapping[str, str] | None = None, partitioned_by: Sequence[str] = (), clustered_by: Sequence[str] = (), primary_key: Sequence[str] | None = None,
        primary_key_name: str | None = None, foreign_keys: Sequence[ForeignKey] = (), scope: str = "full",
    ):
        if scope not in SCOPES:
            raise ValueError(f"unknown scope {scope!r}")
        for part in (catalog, schema, name):
            if not part or len(part) > 255 or re.search(r"[./ \x00-\x1f\x7f]", part):
                raise ValueError(f"{part!r} cannot name a catalog, schema or table")
        self.catalog, self.schema, self.name = catalog.lower(), schema.lower(), name.lower()
        self.columns, self.comment, self.scope = tuple(columns), comment, scope
        self.properties, self.tags = dict(properties or {}), _check_tags(tags or {}, "the table")
        self.partitioned_by, self.clustered_by = _names(partitioned_by, "partitioned_by"), _names(clustered_by, "clustered_by")
        self.primary_key = None if primary_key is None else _names(primary_key, "primary_key")
        self.primary_key_name = primary_key_name
        self._check()
        self.foreign_keys = self._bind(foreign_keys)

    @property
    def table_id(self) -> str:
        return f"{self.catalog}.{self.schema}.{self.name}"

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def manages(self, aspect: str) -> bool:
        return SCOPES[self.scope] >= MINIMUM_SCOPE[aspect]

    def spark_schema(self) -> T.StructType:
        """Order, spelling, type and nullability of the columns."""
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])

    def _check(self) -> None:
        columns = self.columns
        if not columns:
            raise ValueError("a table needs a column")
        _unique([c.name for c in columns], "columns")
        spelled = {c.name: c for c in columns}
        for what, names in (("partitioned_by", self.partitioned_by), ("clustered_by", self.clustered_by)):
            _unique(names, what)
            if missing := [n for n in names if n not in spelled]:
                raise ValueError(f"{what}: {missing[0]} is not a declared column")
        if self.partitioned_by and self.clustered_by:
            raise ValueError("a table is partitioned or clustered, not both")
        if len(self.clustered_by) > 4:
            raise ValueError("at most four clustering columns")
        nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
        if any(isinstance(spelled[n].type, nested) for n in self.partitioned_by) or any(isinstance(spelled[n].type, (*nested, T.BooleanType, T.BinaryType)) for n in self.clustered_by):
            raise ValueError("a layout column has a type that layouts do not take")
        if self.partitioned_by and len(self.partitioned_by) == len(columns):
            raise ValueError("a table needs a column that does not partition it")
        for key, value in self.properties.items():
            if key not in PROPERTIES:
                raise ValueError(f"property {key} is not managed")
            if value is not None and not re.fullmatch(PROPERTIES[key], value):
                raise ValueError(f"{value!r} is no value of {key}")
        self._check_columns()
        if self.primary_key is None:
            if self.primary_key_name is not None:
                raise ValueError("primary_key_name needs primary_key")
        else:
            if not self.primary_key:
                raise ValueError("a primary key needs a column")
            _unique(self.primary_key, "primary_key")
            for n in self.primary_key:
                if n not in spelled:
                    raise ValueError(f"primary_key: {n} is not a declared column")
                if spelled[n].nullable:
                    raise ValueError(f"primary_key: {n} must be declared not null")
            if self.primary_key_name is not None and not self.primary_key_name.strip():
                raise ValueError("primary_key_name is blank")

    def _check_columns(self) -> None:
        mapped = self.properties.get(MAPPING) == "name"
        hints = [c for c in self.columns if c.renamed_from is not None]
        if hints and (not mapped or not self.manages("COLUMN_STRUCTURE")):
            raise ValueError("renames need column mapping by name and a scope that manages columns")
        _unique([c.renamed_from for c in hints], "renamed_from")
        if still := [c.renamed_from for c in hints if self.column(c.renamed_from)]:
            raise ValueError(f"{still[0]} is renamed and still declared")
        if self.manages("COLUMN_STRUCTURE"):
            special = [x for c in self.columns for x in _special_names(c.name, c.type)]
            if special and not mapped:
                raise ValueError(f"the name {special[0]!r} needs column mapping by name")
            if self.properties.get(FEED) == "true" and (taken := [c.name for c in self.columns if c.name.lower() in _RESERVED]):
                raise ValueError(f"{taken[0]} is reserved by the change feed")
        for c in self.columns:
            if _nested_not_null(c.type, not c.nullable):
                raise ValueError(f"column {c.name}: a required nested field needs required containers")

    def _bind(self, keys: Sequence[ForeignKey]) -> tuple[BoundKey, ...]:
        if isinstance(keys, ForeignKey) or isinstance(keys, str):
            raise TypeError("foreign_keys takes a list")
        bound = []
        for key in keys:
            parent = self if key.references == SELF else key.references
            if not isinstance(parent, Table):
                raise TypeError("a foreign key references a declared table or SELF")
            if parent.catalog != self.catalog:
                raise ValueError("a foreign key stays within its catalog")
            if parent.primary_key is None:
                raise ValueError(f"{parent.table_id} has no primary key")
            if isinstance(key.columns, Mapping):
                pairs = list(key.columns.items())
            else:
                local = (key.columns,) if isinstance(key.columns, str) else _names(key.columns, "a foreign key")
                if len(local) == 1 and len(parent.primary_key) == 1:
                    pairs = [(local[0], parent.primary_key[0])]
                elif {n.lower() for n in local} == {n.lower() for n in parent.primary_key}:
                    pairs = [(n, next(p for p in parent.primary_key if p.lower() == n.lower())) for n in local]
                else:
                    raise ValueError("a foreign key of several columns with other names needs a mapping")
            if not pairs:
                raise ValueError("a foreign key needs a column")
            _unique([a for a, _ in pairs], "a foreign key")
            if {b.lower() for _, b in pairs} != {p.lower() for p in parent.primary_key} or len(pairs) != len(parent.primary_key):
                raise ValueError("a foreign key covers exactly the parent's primary key")
            for a, b in pairs:
                mine, theirs = self.column(a), parent.column(b)
                if mine is None or mine.name != a:
                    raise ValueError(f"foreign key: {a} is not a declared column")
                if kinds.canonical(mine.type) != kinds.canonical(theirs.type):
                    raise ValueError(f"foreign key: {a} and {b} differ in type")
            if key.name is not None and not key.name.strip():
                raise ValueError("a foreign key's name is blank")
            pairs = sorted(((a, parent.column(b).name) for a, b in pairs), key=lambda x: x[0].lower())
            bound.append(BoundKey(tuple(a for a, _ in pairs), parent.table_id, tuple(b for _, b in pairs), key.name))
        if len({frozenset(a.lower() for a in k.columns) for k in bound}) < len(bound):
            raise ValueError("two foreign keys share their columns")
        named = [k.name.lower() for k in bound if k.name]
        if len(set(named)) < len(named):
            raise ValueError("two foreign keys share a name")
        return tuple(bound)
