"""Ordered plans: one statement per action, in dependency order of the phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backtick, dotted, literal, name_list, pair

_ALIASES = {"variantType": "variantType-preview"}


def create_statements(d: dict[str, DataFrame]) -> DataFrame:
    """(table_id, create_sql) of every desired table, complete with its key, properties and layout."""
    body = F.concat(backtick(F.col("name")), F.lit(" "), F.col("type_sql"), F.when(F.col("nullable"), "").otherwise(" NOT NULL"),
                    F.when(F.col("comment") != "", F.concat(F.lit(" COMMENT "), literal(F.col("comment")))).otherwise(""))
    in_order = lambda order, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("x")))), lambda s: s["x"]), ", ")
    columns = d["columns"].groupBy("table_id").agg(in_order("ord", body).alias("columns_sql"))
    keys = d["primary_keys"].select("table_id", F.concat(
        F.lit(", "), F.when(F.col("name").isNotNull(), F.concat(F.lit("CONSTRAINT "), backtick(F.col("name")), F.lit(" "))).otherwise(""),
        F.lit("PRIMARY KEY "), name_list(F.col("columns"))).alias("key_sql"))
    props = d["properties"].where(F.col("value").isNotNull()).groupBy("table_id").agg(in_order("key", pair(F.col("key"), F.col("value"))).alias("props_sql"))
    layout = d["layout"].groupBy("table_id", "kind").agg(in_order("pos", backtick(F.col("name"))).alias("layout_sql"))
    layout = layout.select("table_id", F.concat(F.when(F.col("kind") == "partition", " PARTITIONED BY (").otherwise(" CLUSTER BY ("), F.col("layout_sql"), F.lit(")")).alias("layout_sql"))
    t = d["tables"].select("table_id", "comment").join(columns, "table_id").join(keys, "table_id", "left").join(props, "table_id", "left").join(layout, "table_id", "left")
    sql = F.concat(
        F.lit("CREATE TABLE "), dotted(F.col("table_id")), F.lit(" ("), F.col("columns_sql"), F.coalesce("key_sql", F.lit("")), F.lit(") USING delta"),
        F.when(F.col("comment") != "", F.concat(F.lit(" COMMENT "), literal(F.col("comment")))).otherwise(""),
        F.coalesce(F.concat(F.lit(" TBLPROPERTIES ("), F.col("props_sql"), F.lit(")")), F.lit("")), F.coalesce("layout_sql", F.lit("")))
    return t.select("table_id", sql.alias("create_sql"))


def _statement() -> Column:
    table, col = dotted(F.col("table_id")), backtick(F.col("col"))
    alter = F.concat(F.lit("ALTER TABLE "), table, F.lit(" "))
    annotate = F.concat(F.when(F.col("relation_kind") == "STREAMING_TABLE", "ALTER STREAMING TABLE ").otherwise("ALTER TABLE "), table, F.lit(" "))
    named = F.when(F.col("name").isNotNull(), F.concat(F.lit("CONSTRAINT "), backtick(F.col("name")), F.lit(" "))).otherwise("")
    feature = F.col("key")
    for plain, sent in _ALIASES.items():
        feature = F.when(F.col("key") == plain, sent).otherwise(feature)
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    forms = {
        "CreateTable": F.col("create_sql"),
        "EnableTableFeature": text(alter, "SET TBLPROPERTIES (", pair(F.concat(F.lit("delta.feature."), feature), F.lit("supported")), ")"),
        "SetProperty": text(alter, "SET TBLPROPERTIES (", pair(F.col("key"), F.col("value")), ")"),
        "UnsetProperty": text(alter, "UNSET TBLPROPERTIES IF EXISTS (", literal(F.col("key")), ")"),
        "SetTableTag": text(annotate, "SET TAGS (", pair(F.col("tag"), F.col("value")), ")"),
        "UnsetTableTag": text(annotate, "UNSET TAGS (", literal(F.col("tag")), ")"),
        "DropForeignKey": text(alter, "DROP CONSTRAINT IF EXISTS ", backtick(F.col("name"))),
        "DropPrimaryKey": text(alter, "DROP PRIMARY KEY IF EXISTS"),
        "RenameColumn": text(alter, "RENAME COLUMN ", col, " TO ", backtick(F.col("new"))),
        "AddColumn": text(alter, "ADD COLUMN ", col, " ", F.col("type_sql"), F.when(F.col("nullable"), "").otherwise(" NOT NULL"),
                          F.when(F.col("comment") != "", F.concat(F.lit(" COMMENT "), literal(F.col("comment")))).otherwise("")),
        "AlterColumnType": text(alter, "ALTER COLUMN ", col, " TYPE ", F.col("type_sql")),
        "AlterClustering": text(alter, "CLUSTER BY ", F.when(F.size("cols") > 0, name_list(F.col("cols"))).otherwise("NONE")),
        "SetColumnTag": text(annotate, "ALTER COLUMN ", col, " SET TAGS (", pair(F.col("tag"), F.col("value")), ")"),
        "UnsetColumnTag": text(annotate, "ALTER COLUMN ", col, " UNSET TAGS (", literal(F.col("tag")), ")"),
        "DropColumn": text(alter, "DROP COLUMN ", col),
        "SetColumnComment": text(annotate, "ALTER COLUMN ", col, " COMMENT ", literal(F.col("comment"))),
        "SetTableComment": text("COMMENT ON TABLE ", table, " IS ", literal(F.col("comment"))),
        "SetColumnNullability": text(alter, "ALTER COLUMN ", col, F.when(F.col("nullable"), " DROP").otherwise(" SET"), " NOT NULL"),
        "SetPrimaryKey": text(alter, "ADD ", named, "PRIMARY KEY ", name_list(F.col("cols"))),
        "SetForeignKey": text(alter, "ADD ", named, "FOREIGN KEY ", name_list(F.col("cols")), " REFERENCES ", dotted(F.col("parent")), " ", name_list(F.col("parent_cols"))),
    }
    out = F.lit(None).cast("string")
    for action, form in forms.items():
        out = F.when(F.col("action") == action, form).otherwise(out)
    return out


def plan(diff: DataFrame, d: dict[str, DataFrame], o: dict[str, DataFrame]) -> DataFrame:
    """The actions of ``diff`` with their statements and 1-based places within their table."""
    order = Window.partitionBy("table_id").orderBy("phase", F.lower("subject"), "subject", "stream", "pos")
    kind = o["tables"].select("table_id", F.col("kind").alias("relation_kind"))
    found = diff.where("closes").join(kind, "table_id", "left").join(create_statements(d), "table_id", "left")
    return found.withColumns({"stmt_ord": F.row_number().over(order), "statement": _statement()}).drop("create_sql", "relation_kind")
