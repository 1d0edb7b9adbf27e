"""Table state from a catalog's JSON description. Anything malformed fails the read; nothing is skipped."""

from __future__ import annotations

import json

from ..functions import types as kinds
from ..operators.relations import Observed, ObservedColumn

_KINDS = {"MANAGED": "TABLE", "EXTERNAL": "TABLE", "STREAMING_TABLE": "STREAMING_TABLE"}


class MetadataError(ValueError):
    """The description of a table is not what a catalog should return."""


def _text(doc: dict, key: str) -> str:
    value = doc.get(key)
    if value is None:
        return ""
    if not isinstance(value, str):
        raise MetadataError(f"{key} is not text")
    return value


def _names(doc: dict, key: str) -> tuple[str, ...]:
    value = doc.get(key)
    if value is None:
        return ()
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise MetadataError(f"{key} is not a list of names")
    return tuple(value)


def _column(doc: object) -> ObservedColumn:
    if not isinstance(doc, dict) or not isinstance(doc.get("name"), str):
        raise MetadataError("a column has no name")
    nullable = doc.get("nullable", True)
    if not isinstance(nullable, bool):
        raise MetadataError(f"nullability of {doc['name']} is not true or false")
    kind = kinds.from_document(doc.get("type"))
    if kind is None:
        raise MetadataError(f"column {doc['name']} has an unsupported type: {json.dumps(doc.get('type'))[:200]}")
    return ObservedColumn(doc["name"], kind, nullable, _text(doc, "comment"))


def parse_description(text: str, table_id: str, providers: tuple[str, ...] = ("delta",), **attached) -> Observed:
    """One description document as an observed table; ``attached`` holds tags and keys read elsewhere."""
    try:
        doc = json.loads(text)
    except (TypeError, ValueError) as e:
        raise MetadataError(f"the description is not JSON: {e}") from e
    if not isinstance(doc, dict) or not isinstance(doc.get("columns"), list) or not doc["columns"]:
        raise MetadataError("the description has no columns")
    relation, provider = doc.get("type"), doc.get("provider")
    if not isinstance(relation, str) or relation not in _KINDS or not isinstance(provider, str) or provider.lower() not in providers:
        raise MetadataError(f"{table_id} is a {relation} of {provider}, which is not managed here")
    properties = doc.get("table_properties") or {}
    if not isinstance(properties, dict) or not all(isinstance(v, str) for v in properties.values()):
        raise MetadataError("table_properties is not a map of texts")
    return Observed(
        table_id, tuple(_column(c) for c in doc["columns"]), _text(doc, "comment"), _KINDS[relation],
        _names(doc, "partition_columns"), _names(doc, "clustering_columns"), dict(properties), **attached)
