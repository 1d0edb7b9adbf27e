"""Catalog state as relations: one row per table, column, tag, property, layout column, key."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import types as kinds
from .declare import PROPERTIES, SCOPES, BoundKey, Table

_S, _L, _B, _A = pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string())
SCHEMAS: dict[str, dict[str, pa.DataType]] = {
    "tables": {"table_id": _S, "catalog": _S, "schema": _S, "name": _S, "comment": _S, "scope": _L, "kind": _S},
    "columns": {"table_id": _S, "ord": _L, "name": _S, "k": _S, "type_sql": _S, "type_key": _S, "type_display": _S, "type_doc": _S, "nullable": _B, "comment": _S, "renamed_from": _S},
    "tags": {"table_id": _S, "k": _S, "tag": _S, "value": _S, "ord": _L},
    "properties": {"table_id": _S, "key": _S, "value": _S, "ord": _L},
    "layout": {"table_id": _S, "kind": _S, "pos": _L, "name": _S, "k": _S},
    "primary_keys": {"table_id": _S, "name": _S, "columns": _A, "key": _A},
    "foreign_keys": {"table_id": _S, "ord": _L, "name": _S, "columns": _A, "parent": _S, "parent_columns": _A, "key": _S},
    "inbound": {"table_id": _S, "name": _S, "owner": _S},
    "features": {"table_id": _S, "feature": _S},
}


@dataclass(frozen=True)
class ObservedColumn:
    name: str
    type: T.DataType
    nullable: bool = True
    comment: str = ""


@dataclass(frozen=True)
class Observed:
    """The current state of one present table."""

    table_id: str
    columns: Sequence[ObservedColumn]
    comment: str = ""
    kind: str = "TABLE"
    partitioned_by: Sequence[str] = ()
    clustered_by: Sequence[str] = ()
    properties: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    column_tags: dict[str, dict[str, str]] = field(default_factory=dict)
    primary_key: tuple[str, Sequence[str]] | None = None
    foreign_keys: Sequence[BoundKey] = ()
    inbound: Sequence[tuple[str, str]] = ()


def foreign_key_text(columns: Iterable[str], parent: str, parent_columns: Iterable[str]) -> str:
    """Equal texts mean the same foreign key, whatever its name and spelling."""
    pairs = sorted((a.lower(), b.lower()) for a, b in zip(columns, parent_columns, strict=True))
    return "|".join([parent.lower(), *(f"{a}>{b}" for a, b in pairs)])


def supported_features(properties: dict[str, str]) -> set[str]:
    found = {k.removeprefix("delta.feature.") for k, v in properties.items() if k.startswith("delta.feature.") and v == "supported"}
    return {"variantType" if f == "variantType-preview" else f for f in found} & set(kinds.FEATURE_OF.values())


def _rows(of: Table | Observed) -> dict[str, list[dict]]:
    desired = isinstance(of, Table)
    t = of.table_id
    catalog, schema, name = t.split(".")
    out: dict[str, list[dict]] = {k: [] for k in SCHEMAS}
    out["tables"].append({
        "table_id": t, "catalog": catalog, "schema": schema, "name": name, "comment": of.comment,
        "scope": SCOPES[of.scope] if desired else None, "kind": None if desired else of.kind})
    for i, c in enumerate(of.columns):
        out["columns"].append({
            "table_id": t, "ord": i, "name": c.name, "k": c.name.lower(), "type_sql": kinds.render(c.type), "type_key": kinds.canonical(c.type),
            "type_display": kinds.display(c.type), "type_doc": c.type.json(), "nullable": c.nullable, "comment": c.comment,
            "renamed_from": c.renamed_from if desired else None})
    column_tags = {c.name: c.tags for c in of.columns} if desired else of.column_tags
    tags = [(None, k, v) for k, v in of.tags.items()] + [(c.lower(), k, v) for c, x in column_tags.items() for k, v in x.items()]
    out["tags"] += [{"table_id": t, "k": c, "tag": k, "value": v, "ord": i} for i, (c, k, v) in enumerate(tags)]
    out["properties"] += [{"table_id": t, "key": k, "value": v, "ord": i} for i, (k, v) in enumerate(of.properties.items()) if k in PROPERTIES]
    for kind, names in (("partition", of.partitioned_by), ("cluster", of.clustered_by)):
        out["layout"] += [{"table_id": t, "kind": kind, "pos": i, "name": n, "k": n.lower()} for i, n in enumerate(names)]
    key = ((of.primary_key_name, of.primary_key) if of.primary_key is not None else None) if desired else of.primary_key
    if key:
        out["primary_keys"].append({"table_id": t, "name": key[0], "columns": list(key[1]), "key": sorted(c.lower() for c in key[1])})
    for i, f in enumerate(of.foreign_keys):
        out["foreign_keys"].append({
            "table_id": t, "ord": i, "name": f.name, "columns": list(f.columns), "parent": f.parent, "parent_columns": list(f.parent_columns),
            "key": foreign_key_text(f.columns, f.parent, f.parent_columns)})
    if desired:
        out["features"] += [{"table_id": t, "feature": f} for f in sorted(set().union(*(kinds.features(c.type) for c in of.columns)))]
    else:
        out["features"] += [{"table_id": t, "feature": f} for f in sorted(supported_features(of.properties))]
        out["inbound"] += [{"table_id": t, "name": n, "owner": o} for n, o in of.inbound]
    return out


def relations(spark: SparkSession, tables: Iterable[Table | Observed]) -> dict[str, DataFrame]:
    """The relations of many tables at once, as local data that needs no job."""
    rows: dict[str, list[dict]] = {k: [] for k in SCHEMAS}
    for of in tables:
        for k, more in _rows(of).items():
            rows[k] += more
    return {k: spark.createDataFrame(pa.Table.from_pylist(rows[k], pa.schema(list(fields.items())))) for k, fields in SCHEMAS.items()}
