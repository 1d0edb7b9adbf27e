"""What declarations are written with."""

from pyspark.sql.types import (
    ArrayType as Array,
    BinaryType as Binary,
    BooleanType as Boolean,
    ByteType as Byte,
    DateType as Date,
    DecimalType as Decimal,
    DoubleType as Double,
    FloatType as Float,
    IntegerType as Integer,
    LongType as Long,
    MapType as Map,
    ShortType as Short,
    StringType as String,
    StructField,
    StructType as Struct,
    TimestampNTZType as TimestampNtz,
    TimestampType as Timestamp,
    VariantType as Variant,
)

from .operators.declare import SELF, Column, ForeignKey, Property, Table

__all__ = [
    "SELF", "Array", "Binary", "Boolean", "Byte", "Column", "Date", "Decimal", "Double", "Float", "ForeignKey", "Integer", "Long", "Map", "Property", "Short", "String",
    "Struct", "StructField", "Table", "Timestamp", "TimestampNtz", "Variant",
]
