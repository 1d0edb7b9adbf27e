"""Differences between desired and observed relations, as one relation.

Every comparison is a keyed join over all tables at once. A row is either an
``action`` that closes a difference, or ``unresolvable``. ``stream`` and ``pos`` carry the order
in which differences are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .declare import MINIMUM_SCOPE

# Actions in execution order, each with its aspect.
PHASES = {
    "CreateTable": "TABLE_EXISTENCE", "EnableTableFeature": "COLUMN_STRUCTURE", "SetProperty": "PROPERTIES", "UnsetProperty": "PROPERTIES",
    "SetTableTag": "TABLE_TAGS", "UnsetTableTag": "TABLE_TAGS", "DropForeignKey": "FOREIGN_KEYS", "DropPrimaryKey": "PRIMARY_KEY",
    "RenameColumn": "COLUMN_STRUCTURE", "AddColumn": "COLUMN_STRUCTURE", "AlterColumnType": "COLUMN_STRUCTURE", "AlterClustering": "CLUSTERING",
    "SetColumnTag": "COLUMN_TAGS", "UnsetColumnTag": "COLUMN_TAGS", "DropColumn": "COLUMN_STRUCTURE", "SetColumnComment": "COLUMN_COMMENTS",
    "SetTableComment": "TABLE_COMMENT", "SetColumnNullability": "COLUMN_STRUCTURE", "SetPrimaryKey": "PRIMARY_KEY", "SetForeignKey": "FOREIGN_KEYS",
}
UNRESOLVABLE = {"ColumnRenameConflict": "COLUMN_STRUCTURE", "ColumnCaseDrift": "COLUMN_STRUCTURE", "PropertyUndeclared": "PROPERTIES", "PartitioningChanged": "PARTITIONING"}
# the order of the streams: features, renames, columns, layout, constraints, metadata; then what no action can close
CREATE, FEATURES, RENAMES, COLUMNS, LAYOUT, CONSTRAINTS, METADATA, CONFLICTS, CASE, LOOSE, PARTITIONS = range(11)

FIELDS = {
    "subject": "string", "col": "string", "new": "string", "tag": "string", "key": "string", "value": "string", "old": "string", "type_sql": "string",
    "old_sql": "string", "type_doc": "string", "old_doc": "string", "display": "string", "old_display": "string", "nullable": "boolean", "comment": "string",
    "old_comment": "string", "cols": "array<string>", "old_cols": "array<string>", "parent": "string", "parent_cols": "array<string>", "name": "string",
}
Relations = dict[str, DataFrame]


def _emit(df: DataFrame, action: str, stream: int, pos: Column, **fields: Column) -> DataFrame:
    """The differences of one kind, with the fields that the kind has."""
    return df.select("table_id", F.lit(action).alias("action"), F.lit(stream).alias("stream"), pos.cast("long").alias("pos"), *[v.alias(f) for f, v in fields.items()])


def _union(parts: list[DataFrame]) -> DataFrame:
    """All kinds together; fields that a kind lacks are null."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _complete(found: DataFrame) -> DataFrame:
    """Every field in its type and place, with what follows from the action."""
    lookup = lambda of: ", ".join(f"'{k}', {v}" for k, v in of.items())
    aspects = lookup({k: f"'{v}'" for k, v in (PHASES | UNRESOLVABLE).items()})
    phases = lookup({k: i for i, k in enumerate(PHASES, 1)})
    fields = [f"CAST({f if f in found.columns else 'NULL'} AS {t}) AS {f}" for f, t in FIELDS.items()]
    return found.selectExpr(
        "table_id", "action", f"map_contains_key(map({phases}), action) AS closes", f"map({aspects})[action] AS aspect", f"CAST(map({phases})[action] AS INT) AS phase", "stream", "pos", *fields)


# Plans over metadata are wide and their data is small: one partition, and no time spent on compiling or re-planning them.
_SMALL = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}


@contextmanager
def small_plans(spark: SparkSession) -> Iterator[None]:
    """Settings for actions on metadata; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _SMALL}
    try:
        for k, v in _SMALL.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settle(df: DataFrame) -> DataFrame:
    """The same rows as local data. Metadata of declared tables fits the driver, and each
    step of a long derivation is then planned on its own, in linear time."""
    with small_plans(df.sparkSession):
        return df.sparkSession.createDataFrame(df.toArrow())


def _as(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("table_id",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def rename_projection(d: Relations, o: Relations) -> tuple[DataFrame, DataFrame]:
    """Observed columns as renames would leave them, and each hint's verdict (applied, conflict or neither)."""
    hints = d["columns"].where(F.col("renamed_from").isNotNull()).select("table_id", "ord", F.col("name").alias("new"), F.col("k").alias("new_k"), "renamed_from", F.lower("renamed_from").alias("src_k"))
    raw = o["columns"].select("table_id", F.col("k").alias("src_k"), F.col("name").alias("src"))
    hints = hints.join(raw, ["table_id", "src_k"], "left")
    hints = hints.join(o["columns"].select("table_id", F.col("k").alias("new_k"), F.col("name").alias("target")), ["table_id", "new_k"], "left")
    found, taken = F.col("src").isNotNull(), F.col("target").isNotNull()
    hints = hints.withColumns({"applied": found & ~taken, "conflict": found & taken})
    of = hints.select("table_id", F.col("src_k").alias("k"), "new", "new_k", "applied", "conflict")
    columns = o["columns"].join(of, ["table_id", "k"], "left").where(~F.coalesce("conflict", F.lit(False)))
    applied = F.coalesce("applied", F.lit(False))
    columns = columns.withColumns({"k": F.when(applied, F.col("new_k")).otherwise(F.col("k")), "name": F.when(applied, F.col("new")).otherwise(F.col("name"))})
    return columns.drop("new", "new_k", "applied", "conflict"), hints


def _column_differences(d: Relations, o: Relations, present: DataFrame, columns: DataFrame, hints: DataFrame) -> list[DataFrame]:
    mine = d["columns"].join(present, "table_id", "left_semi")
    both = _as(mine, "d_", ("table_id", "k")).join(_as(columns, "o_", ("table_id", "k")), ["table_id", "k"], "full_outer")
    added, removed = both.where(F.col("o_name").isNull()), both.where(F.col("d_name").isNull())
    matched = both.where(F.col("o_name").isNotNull() & F.col("d_name").isNotNull())
    # declared columns first in their order, removed ones after them in the catalog's
    at = F.col("d_ord") * 1000
    gone = F.lit(10**9).cast("long") + F.col("o_ord") * 1000
    parts = [
        _emit(hints.where("applied"), "RenameColumn", RENAMES, F.col("ord"), subject=F.col("src"), col=F.col("src"), new=F.col("new")),
        _emit(hints.where("conflict"), "ColumnRenameConflict", CONFLICTS, F.col("ord"), subject=F.col("src"), col=F.col("src"), new=F.col("target")),
        _emit(added, "AddColumn", COLUMNS, at, subject=F.col("d_name"), col=F.col("d_name"), type_sql=F.col("d_type_sql"), type_doc=F.col("d_type_doc"),
              display=F.col("d_type_display"), nullable=F.col("d_nullable"), comment=F.col("d_comment")),
        _emit(removed, "DropColumn", COLUMNS, gone + 999, subject=F.col("o_name"), col=F.col("o_name"), old_display=F.col("o_type_display")),
        _emit(matched.where(F.col("d_type_key") != F.col("o_type_key")), "AlterColumnType", COLUMNS, at + 1, subject=F.col("o_name"), col=F.col("o_name"),
              type_sql=F.col("d_type_sql"), type_doc=F.col("d_type_doc"), old_doc=F.col("o_type_doc"), old_sql=F.col("o_type_sql"), display=F.col("d_type_display"), old_display=F.col("o_type_display")),
        _emit(matched.where(F.col("d_nullable") != F.col("o_nullable")), "SetColumnNullability", COLUMNS, at + 2, subject=F.col("o_name"), col=F.col("o_name"), nullable=F.col("d_nullable")),
        _emit(matched.where(F.col("d_comment") != F.col("o_comment")), "SetColumnComment", COLUMNS, at + 3, subject=F.col("o_name"), col=F.col("o_name"),
              comment=F.col("d_comment"), old_comment=F.col("o_comment")),
        _emit(matched.where(F.col("d_name") != F.col("o_name")), "ColumnCaseDrift", CASE, at, subject=F.col("d_name"), col=F.col("d_name"), old=F.col("o_name")),
        _emit(hints.where(F.col("src").isNotNull() & (F.col("src") != F.col("renamed_from"))), "ColumnCaseDrift", CASE, F.col("ord") * 1000 + 1,
              subject=F.col("renamed_from"), col=F.col("renamed_from"), old=F.col("src")),
    ]
    # tags by column, full state; a renamed column keeps the tags that its old name has
    old_tags = o["tags"].where(F.col("k").isNotNull())
    moved = hints.where("applied").select("table_id", F.col("src_k").alias("k"), "new_k")
    old_tags = old_tags.join(moved, ["table_id", "k"], "left").withColumn("k", F.coalesce("new_k", "k")).drop("new_k")
    tags = _as(d["tags"].where(F.col("k").isNotNull()).join(present, "table_id", "left_semi"), "d_", ("table_id", "k", "tag"))
    tags = tags.join(_as(old_tags, "o_", ("table_id", "k", "tag")), ["table_id", "k", "tag"], "full_outer").join(both.select("table_id", "k", "d_name", "o_name", F.col("d_ord").alias("c_ord"), F.col("o_ord").alias("r_ord")), ["table_id", "k"])
    spelled = F.coalesce("o_name", "d_name")
    subject = F.concat(spelled, F.lit("."), F.col("tag"))
    value_differs = F.col("d_value").isNotNull() & (F.col("o_value").isNull() | (F.col("d_value") != F.col("o_value")))
    place = F.coalesce(F.col("c_ord") * 1000, F.lit(10**9).cast("long") + F.col("r_ord") * 1000)
    parts += [
        _emit(tags.where(value_differs), "SetColumnTag", COLUMNS, place + 10, subject=subject, col=spelled, tag=F.col("tag"), value=F.col("d_value"), old=F.col("o_value")),
        _emit(tags.where(F.col("d_value").isNull()), "UnsetColumnTag", COLUMNS, place + 100, subject=subject, col=spelled, tag=F.col("tag"), old=F.col("o_value")),
    ]
    return parts


def _layout_differences(d: Relations, o: Relations, present: DataFrame, hints: DataFrame) -> list[DataFrame]:
    moved = hints.where("applied").select("table_id", F.col("src_k").alias("k"), "new", "new_k")
    theirs = o["layout"].join(moved, ["table_id", "k"], "left").withColumns({"name": F.coalesce("new", "name"), "k": F.coalesce("new_k", "k")})
    lists = lambda df: df.groupBy("table_id", "kind").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "k"))).alias("x")).select("table_id", "kind", F.col("x.name").alias("names"), F.col("x.k").alias("ks"))
    kinds = present.select("table_id", F.explode(F.array(F.lit("partition"), F.lit("cluster"))).alias("kind"))
    both = kinds.join(_as(lists(d["layout"]), "d_", ("table_id", "kind")), ["table_id", "kind"], "left").join(_as(lists(theirs), "o_", ("table_id", "kind")), ["table_id", "kind"], "left")
    empty = F.array().cast("array<string>")
    for c in ("d_names", "d_ks", "o_names", "o_ks"):
        both = both.withColumn(c, F.coalesce(c, empty))
    clusters = both.where((F.col("kind") == "cluster") & (F.array_sort("d_ks") != F.array_sort("o_ks")))
    partitions = both.where((F.col("kind") == "partition") & (F.col("d_ks") != F.col("o_ks")))
    return [
        _emit(clusters, "AlterClustering", LAYOUT, F.lit(0), subject=F.lit(""), cols=F.col("d_names"), old_cols=F.col("o_names")),
        _emit(partitions, "PartitioningChanged", PARTITIONS, F.lit(0), subject=F.lit(""), cols=F.col("d_names"), old_cols=F.col("o_names")),
    ]


def _set_primary(df: DataFrame) -> DataFrame:
    return _emit(df, "SetPrimaryKey", CONSTRAINTS, F.lit(1), subject=F.coalesce("name", F.array_join("columns", ", ")), name=F.col("name"), cols=F.col("columns"))


def _set_foreign(df: DataFrame) -> DataFrame:
    return _emit(df, "SetForeignKey", CONSTRAINTS, F.lit(1000) + F.col("ord"), subject=F.coalesce("name", F.array_join("columns", ", ")), name=F.col("name"),
                 cols=F.col("columns"), parent=F.col("parent"), parent_cols=F.col("parent_columns"))


def _constraint_differences(d: Relations, o: Relations, present: DataFrame) -> list[DataFrame]:
    mine = d["primary_keys"].join(present, "table_id", "left_semi")
    theirs = o["primary_keys"].select("table_id", F.col("name").alias("o_name"), F.col("columns").alias("o_columns"), F.col("key").alias("o_key"))
    both = mine.join(theirs, "table_id", "full_outer").where(~F.col("key").eqNullSafe(F.col("o_key")))
    drops = both.where(F.col("o_key").isNotNull())
    # equal definitions are numbered, so that repeated constraints match one to one
    nth = F.row_number().over(Window.partitionBy("table_id", "key").orderBy("ord"))
    left = d["foreign_keys"].join(present, "table_id", "left_semi").withColumn("nth", nth)
    right = o["foreign_keys"].withColumn("nth", nth).select("table_id", "key", "nth", *[F.col(c).alias(f"o_{c}") for c in ("ord", "name", "columns", "parent")])
    keys = left.join(right, ["table_id", "key", "nth"], "full_outer")
    return [
        _emit(drops, "DropPrimaryKey", CONSTRAINTS, F.lit(0), subject=F.coalesce("o_name", F.lit("")), name=F.col("o_name"), old_cols=F.col("o_columns")),
        _set_primary(both.where(F.col("key").isNotNull())),
        _emit(keys.where(F.col("ord").isNull()), "DropForeignKey", CONSTRAINTS, F.lit(100) + F.col("o_ord"), subject=F.col("o_name"), name=F.col("o_name"),
              old_cols=F.col("o_columns"), parent=F.col("o_parent")),
        _set_foreign(keys.where(F.col("o_ord").isNull())),
    ]


def _metadata_differences(d: Relations, o: Relations, present: DataFrame) -> list[DataFrame]:
    managed = present.where(F.col("scope") >= MINIMUM_SCOPE["PROPERTIES"])
    mine = d["properties"].join(managed, "table_id", "left_semi").select("table_id", "key", F.col("value").alias("d_value"), F.col("ord").alias("d_ord"), F.lit(True).alias("declared"))
    theirs = o["properties"].join(managed, "table_id", "left_semi").select("table_id", "key", F.col("value").alias("o_value"), F.col("ord").alias("o_ord"))
    both = mine.join(theirs, ["table_id", "key"], "full_outer").withColumn("declared", F.coalesce("declared", F.lit(False)))
    wants, has = F.col("d_value").isNotNull(), F.col("o_value").isNotNull()
    tags = d["tags"].where(F.col("k").isNull()).join(present, "table_id", "left_semi").select("table_id", "tag", F.col("value").alias("d_value"), F.col("ord").alias("d_ord"))
    tags = tags.join(o["tags"].where(F.col("k").isNull()).select("table_id", "tag", F.col("value").alias("o_value"), F.col("ord").alias("o_ord")), ["table_id", "tag"], "full_outer")
    comments = present.join(d["tables"].select("table_id", "comment"), "table_id").join(o["tables"].select("table_id", F.col("comment").alias("old_comment")), "table_id")
    prop = {"subject": F.col("key"), "key": F.col("key"), "value": F.col("d_value"), "old": F.col("o_value")}
    tag = {"subject": F.col("tag"), "tag": F.col("tag"), "value": F.col("d_value"), "old": F.col("o_value")}
    return [
        _emit(comments.where(F.col("comment") != F.col("old_comment")), "SetTableComment", METADATA, F.lit(0), subject=F.lit(""), comment=F.col("comment"), old_comment=F.col("old_comment")),
        _emit(both.where(wants & ~(has & (F.col("d_value") == F.col("o_value")))), "SetProperty", METADATA, F.lit(1000) + F.col("d_ord"), **prop),
        _emit(both.where(F.col("declared") & ~wants & has), "UnsetProperty", METADATA, F.lit(1000) + F.col("d_ord"), **prop),
        _emit(both.where(~F.col("declared") & has), "PropertyUndeclared", LOOSE, F.col("o_ord"), **prop),
        _emit(tags.where(wants & ~(has & (F.col("d_value") == F.col("o_value")))), "SetTableTag", METADATA, F.lit(2000) + F.col("d_ord"), **tag),
        _emit(tags.where(~wants & has), "UnsetTableTag", METADATA, F.lit(3000) + F.col("o_ord"), **tag),
    ]


def _creations(d: Relations, absent: DataFrame) -> list[DataFrame]:
    only = lambda r: d[r].join(absent, "table_id", "left_semi")
    columns = only("columns").select("table_id", "k", "name", "ord")
    tags = only("tags").where(F.col("k").isNotNull()).withColumnRenamed("ord", "nth").join(columns, ["table_id", "k"])
    return [
        _emit(absent, "CreateTable", CREATE, F.lit(0), subject=F.lit("")),
        _emit(only("tags").where(F.col("k").isNull()), "SetTableTag", METADATA, F.lit(2000) + F.col("ord"), subject=F.col("tag"), tag=F.col("tag"), value=F.col("value")),
        _emit(tags, "SetColumnTag", METADATA, F.lit(10_000) + F.col("nth"), subject=F.concat("name", F.lit("."), "tag"), col=F.col("name"), tag=F.col("tag"), value=F.col("value")),
        _set_foreign(only("foreign_keys")),
    ]


def differences(d: Relations, o: Relations) -> DataFrame:
    """All differences of all desired tables, one row each."""
    wanted = d["tables"].select("table_id", "scope")
    known = o["tables"].select("table_id")
    present, absent = settle(wanted.join(known, "table_id", "left_semi")), settle(wanted.join(known, "table_id", "left_anti"))
    # catalog state of tables that nobody declares is not compared
    o = {k: df.join(wanted, "table_id", "left_semi") for k, df in o.items()}
    columns, hints = map(settle, rename_projection({**d, "columns": d["columns"].join(present, "table_id", "left_semi")}, o))
    features = d["features"].join(present, "table_id", "left_semi").join(o["features"], ["table_id", "feature"], "left_anti")
    order = F.row_number().over(Window.partitionBy("table_id").orderBy("feature"))
    enabled = _emit(features.withColumn("n", order), "EnableTableFeature", FEATURES, F.col("n"), subject=F.col("feature"), key=F.col("feature"))
    groups = [
        [*_creations(d, absent), enabled],
        _column_differences(d, o, present, columns, hints),
        [*_layout_differences(d, o, present, hints), *_constraint_differences(d, o, present)],
        _metadata_differences(d, o, present),
    ]
    return settle(_complete(_union([settle(_union(parts)) for parts in groups])))
