"""Keys and tags from relations in the shape of ``information_schema``: plain equi-joins and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["constraint_catalog", "constraint_schema", "constraint_name"]


def _of(df: DataFrame, catalog: str, schema: str, table: str, prefix: str = "table_") -> DataFrame:
    return df.where((F.lower(f"{prefix}catalog") == catalog) & (F.lower(f"{prefix}schema") == schema) & (F.lower(f"{prefix}name") == table))


def schema_exists(schemata: DataFrame, schema: str) -> DataFrame:
    """One row if the schema exists, none otherwise."""
    return schemata.where(F.lower("schema_name") == schema).select("schema_name").limit(1)


def primary_key(table_constraints: DataFrame, key_column_usage: DataFrame, catalog: str, schema: str, table: str) -> DataFrame:
    """constraint_name, column_name in key order."""
    keys = _of(table_constraints, catalog, schema, table).where(F.col("constraint_type") == "PRIMARY KEY").select(*_KEY)
    return keys.join(key_column_usage, _KEY).orderBy("ordinal_position").select("constraint_name", "column_name", "ordinal_position")


def foreign_keys(referential: DataFrame, table_constraints: DataFrame, key_column_usage: DataFrame, catalog: str, schema: str, table: str) -> DataFrame:
    """Outbound keys, a row per column pair. Pairs follow ``position_in_unique_constraint``, not the list position."""
    unique = [F.col(f"unique_{c}").alias(f"u_{c}") for c in _KEY]
    own = _of(key_column_usage, catalog, schema, table).select(*_KEY, F.col("column_name").alias("local_column"), "ordinal_position", "position_in_unique_constraint")
    parent = key_column_usage.select(*[F.col(c).alias(f"u_{c}") for c in _KEY], F.col("column_name").alias("referenced_column"), F.col("ordinal_position").alias("position_in_unique_constraint"))
    owner = table_constraints.select(*[F.col(c).alias(f"u_{c}") for c in _KEY], F.col("table_catalog").alias("referenced_catalog"), F.col("table_schema").alias("referenced_schema"), F.col("table_name").alias("referenced_table"))
    u = [f"u_{c}" for c in _KEY]
    found = referential.select(*_KEY, *unique).join(own, _KEY).join(parent, [*u, "position_in_unique_constraint"]).join(owner, u)
    return found.orderBy("constraint_name", "ordinal_position").select("constraint_name", "local_column", "referenced_catalog", "referenced_schema", "referenced_table", "referenced_column", "ordinal_position")


def inbound_keys(referential: DataFrame, table_constraints: DataFrame, catalog: str, schema: str, table: str) -> DataFrame:
    """Foreign keys of any table whose parent is this table's primary key; unique constraints don't count."""
    mine = _of(table_constraints, catalog, schema, table).where(F.col("constraint_type") == "PRIMARY KEY").select(*[F.col(c).alias(f"u_{c}") for c in _KEY])
    referring = table_constraints.select(*_KEY, F.col("table_catalog").alias("referencing_catalog"), F.col("table_schema").alias("referencing_schema"), F.col("table_name").alias("referencing_table"))
    found = referential.select(*_KEY, *[F.col(f"unique_{c}").alias(f"u_{c}") for c in _KEY]).join(mine, [f"u_{c}" for c in _KEY]).join(referring, _KEY)
    columns = ["constraint_name", "referencing_catalog", "referencing_schema", "referencing_table"]
    return found.orderBy(*columns[1:], columns[0]).select(*columns)


def table_tags(tags: DataFrame, catalog: str, schema: str, table: str) -> DataFrame:
    return tags.where((F.lower("catalog_name") == catalog) & (F.lower("schema_name") == schema) & (F.lower("table_name") == table)).select("tag_name", "tag_value")


def column_tags(tags: DataFrame, catalog: str, schema: str, table: str) -> DataFrame:
    """Tags of all columns in one scan."""
    return tags.where((F.lower("catalog_name") == catalog) & (F.lower("schema_name") == schema) & (F.lower("table_name") == table)).select("column_name", "tag_name", "tag_value")


def attached(r: dict[str, DataFrame], table_ids: list[str]) -> DataFrame:
    """Keys and tags of many tables at once: table_id, kind, name, ord, a, b and other.

    ``a`` is a column, ``b`` a referenced column or a tag's value, ``other`` the table at the other end of a key.
    Every relation is scanned once or twice, whatever the number of tables.
    """
    spark = r["table_constraints"].sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in table_ids], "table_id string"))  # the declared tables
    dotted = lambda *parts: F.lower(F.concat_ws(".", *parts))
    owner = dotted("table_catalog", "table_schema", "table_name")
    none = F.lit(None).cast("string")
    shape = lambda df, kind, name, place, a, b, other: df.select(
        "table_id", F.lit(kind).alias("kind"), name.alias("name"), place.cast("long").alias("ord"), a.cast("string").alias("a"), b.cast("string").alias("b"), other.cast("string").alias("other"))
    c = F.col
    constraints = r["table_constraints"].select(*_KEY, "constraint_type", owner.alias("table_id"))
    primary = constraints.where(c("constraint_type") == "PRIMARY KEY").join(wanted, "table_id")
    used = r["key_column_usage"].select(*_KEY, "column_name", "ordinal_position", "position_in_unique_constraint")
    u = [f"u_{k}" for k in _KEY]
    edges = r["referential_constraints"].select(*_KEY, *[c(f"unique_{k}").alias(f"u_{k}") for k in _KEY])
    as_unique = lambda df, *more: df.select(*[c(k).alias(f"u_{k}") for k in _KEY], *more)
    parents = as_unique(used, c("column_name").alias("referenced"), c("ordinal_position").alias("position_in_unique_constraint"))
    ends = as_unique(constraints, c("table_id").alias("other"))
    local = constraints.join(wanted, "table_id").select(*_KEY, "table_id").join(used, _KEY)
    foreign = edges.join(local, _KEY).join(parents, [*u, "position_in_unique_constraint"]).join(ends, u)
    inbound = edges.join(as_unique(primary, "table_id"), u).join(constraints.select(*_KEY, c("table_id").alias("other")), _KEY)
    tagged = dotted("catalog_name", "schema_name", "table_name").alias("table_id")
    by_table = r["table_tags"].select(tagged, "tag_name", "tag_value").join(wanted, "table_id")
    by_column = r["column_tags"].select(tagged, "column_name", "tag_name", "tag_value").join(wanted, "table_id")
    zero = F.lit(0)
    return (
        shape(primary.join(used, _KEY), "primary_key", c("constraint_name"), c("ordinal_position"), c("column_name"), none, none)
        .unionByName(shape(foreign, "foreign_key", c("constraint_name"), c("ordinal_position"), c("column_name"), c("referenced"), c("other")))
        .unionByName(shape(inbound, "inbound", c("constraint_name"), zero, none, none, c("other")))
        .unionByName(shape(by_table, "table_tag", c("tag_name"), zero, none, c("tag_value"), none))
        .unionByName(shape(by_column, "column_tag", c("tag_name"), zero, c("column_name"), c("tag_value"), none)))
