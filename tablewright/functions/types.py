"""Column types: SQL text, display text, canonical form, catalog documents, required features.

Types are those of ``pyspark.sql.types``. The set is closed: anything else is unmappable.
"""

from __future__ import annotations

import json

from pyspark.sql import types as T

# SQL name, display name and catalog spellings of each scalar type.
SCALARS: dict[type[T.DataType], tuple[str, str, tuple[str, ...]]] = {
    T.ByteType: ("TINYINT", "Byte", ("tinyint", "byte")),
    T.ShortType: ("SMALLINT", "Short", ("smallint", "short")),
    T.IntegerType: ("INT", "Integer", ("int", "integer")),
    T.LongType: ("BIGINT", "Long", ("bigint", "long")),
    T.FloatType: ("FLOAT", "Float", ("float", "real")),
    T.DoubleType: ("DOUBLE", "Double", ("double",)),
    T.BooleanType: ("BOOLEAN", "Boolean", ("boolean",)),
    T.StringType: ("STRING", "String", ("string", "char", "varchar", "character")),
    T.BinaryType: ("BINARY", "Binary", ("binary",)),
    T.DateType: ("DATE", "Date", ("date",)),
    T.TimestampType: ("TIMESTAMP", "Timestamp", ("timestamp", "timestamp_ltz")),
    T.TimestampNTZType: ("TIMESTAMP_NTZ", "TimestampNtz", ("timestamp_ntz",)),
    T.VariantType: ("VARIANT", "Variant", ("variant",)),
}
_BY_NAME = {name: kind for kind, (_, _, names) in SCALARS.items() for name in names}
FEATURE_OF = {T.TimestampNTZType: "timestampNtz", T.VariantType: "variantType"}
_DECIMAL_NAMES = ("decimal", "dec", "numeric")


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def check(kind: T.DataType) -> T.DataType:
    """The type itself if it is supported; a ``TypeError`` or ``ValueError`` otherwise."""
    if type(kind) in SCALARS:
        return kind
    if isinstance(kind, T.DecimalType):
        p, s = kind.precision, kind.scale
        if type(p) is not int or type(s) is not int:
            raise TypeError("decimal precision and scale must be int")
        if not 1 <= p <= 38 or not 0 <= s <= p:
            raise ValueError(f"decimal({p},{s}) is out of range")
        return kind
    if isinstance(kind, T.ArrayType):
        check(kind.elementType)
        return kind
    if isinstance(kind, T.MapType):
        if isinstance(kind.keyType, T.MapType):
            raise ValueError("a map key cannot be a map")
        check(kind.keyType)
        check(kind.valueType)
        return kind
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields]
        if not names:
            raise ValueError("a struct needs a field")
        if any(not n.strip() for n in names) or len({n.lower() for n in names}) < len(names):
            raise ValueError("struct field names must be distinct and not blank")
        for f in kind.fields:
            check(f.dataType)
        return kind
    raise TypeError(f"{kind!r} is not a supported column type")


def render(kind: T.DataType) -> str:
    """SQL text."""
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{render(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"MAP<{render(kind.keyType)},{render(kind.valueType)}>"
    if isinstance(kind, T.StructType):
        return "STRUCT<" + ", ".join(f"{quote_name(f.name)}: {render(f.dataType)}" + " NOT NULL" * (not f.nullable) for f in kind.fields) + ">"
    return SCALARS[type(kind)][0]


def display(kind: T.DataType) -> str:
    """Text for messages and diffs."""
    if isinstance(kind, T.DecimalType):
        return f"Decimal({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"Array<{display(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"Map<{display(kind.keyType)}, {display(kind.valueType)}>"
    if isinstance(kind, T.StructType):
        return "Struct<" + ", ".join(f"{f.name}: {display(f.dataType)}" + " NOT NULL" * (not f.nullable) for f in kind.fields) + ">"
    return SCALARS[type(kind)][1]


def canonical(kind: T.DataType) -> str:
    """Equal texts mean equal types: field names ignore case, element and value nullability is not part of a type."""
    if isinstance(kind, T.ArrayType):
        return f"array<{canonical(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{canonical(kind.keyType)},{canonical(kind.valueType)}>"
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(json.dumps(f.name.lower()) + f":{canonical(f.dataType)}:{f.nullable:d}" for f in kind.fields) + ">"
    return render(kind).lower()


def features(kind: T.DataType) -> set[str]:
    """Table features that a type tree needs."""
    if isinstance(kind, T.ArrayType):
        return features(kind.elementType)
    if isinstance(kind, T.MapType):
        return features(kind.keyType) | features(kind.valueType)
    if isinstance(kind, T.StructType):
        return set().union(*(features(f.dataType) for f in kind.fields))
    return {FEATURE_OF[type(kind)]} if type(kind) in FEATURE_OF else set()


def from_document(doc: object) -> T.DataType | None:
    """A type from a catalog's JSON document; None if it cannot be mapped."""
    try:
        return _parse(doc)
    except RecursionError:
        return None


def _parse(doc: object) -> T.DataType | None:
    if not isinstance(doc, dict) or not isinstance(doc.get("name"), str):
        return None
    name = doc["name"].lower()
    if name in _DECIMAL_NAMES:
        p, s = doc.get("precision"), doc.get("scale")
        if type(p) is not int or type(s) is not int or not 1 <= p <= 38 or not 0 <= s <= p:
            return None
        return T.DecimalType(p, s)
    if name == "array":
        element = _parse(doc.get("element_type"))
        return None if element is None else T.ArrayType(element)
    if name == "map":
        key, value = _parse(doc.get("key_type")), _parse(doc.get("value_type"))
        return None if key is None or value is None or isinstance(key, T.MapType) else T.MapType(key, value)
    if name == "struct":
        fields = doc.get("fields")
        if not isinstance(fields, list) or not fields:
            return None
        made = []
        for f in fields:
            kind = _parse(f.get("type")) if isinstance(f, dict) else None
            nullable = f.get("nullable", True) if isinstance(f, dict) else None
            if kind is None or not isinstance(f.get("name"), str) or not f["name"].strip() or not isinstance(nullable, bool):
                return None
            made.append(T.StructField(f["name"], kind, nullable))
        return T.StructType(made) if len({f.name.lower() for f in made}) == len(made) else None
    if name in _BY_NAME:
        if _BY_NAME[name] is T.StringType and doc.get("collation", "UTF8_BINARY") != "UTF8_BINARY":
            return None
        return _BY_NAME[name]()
    return None


def to_document(kind: T.DataType) -> dict:
    """The JSON document that ``from_document`` reads."""
    if isinstance(kind, T.DecimalType):
        return {"name": "decimal", "precision": kind.precision, "scale": kind.scale}
    if isinstance(kind, T.ArrayType):
        return {"name": "array", "element_type": to_document(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"name": "map", "key_type": to_document(kind.keyType), "value_type": to_document(kind.valueType)}
    if isinstance(kind, T.StructType):
        return {"name": "struct", "fields": [{"name": f.name, "type": to_document(f.dataType), "nullable": f.nullable} for f in kind.fields]}
    return {"name": SCALARS[type(kind)][2][0]}


_RANK = {T.ByteType: 0, T.ShortType: 1, T.IntegerType: 2, T.LongType: 3}


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether a column of type ``old`` may become ``new`` without rewriting rows."""
    if isinstance(new, T.DecimalType):
        whole = new.precision - new.scale
        if isinstance(old, T.DecimalType):
            return (old.precision, old.scale) != (new.precision, new.scale) and new.scale >= old.scale and whole >= old.precision - old.scale
        return type(old) in _RANK and whole >= (20 if isinstance(old, T.LongType) else 10)
    if type(old) in _RANK and type(new) in _RANK:
        return _RANK[type(old)] < _RANK[type(new)]
    if isinstance(new, T.DoubleType):
        return isinstance(old, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType))
    return isinstance(old, T.DateType) and isinstance(new, T.TimestampNTZType)
