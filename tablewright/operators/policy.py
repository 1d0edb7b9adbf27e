"""Which differences are safe: eligibility checks and safety rules as predicates over the difference relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .declare import MAPPING, MINIMUM_SCOPE, SCOPES, TRANSITIONS, WIDENING
from .differ import settle

_ORDER = {"add": "+", "remove": "-", "change": "~"}


def widening(old: Column, new: Column) -> Column:
    """Whether a column whose SQL type is ``old`` may become ``new`` by a metadata change."""
    rank = F.create_map(*[F.lit(x) for kv in {"TINYINT": 0, "SMALLINT": 1, "INT": 2, "BIGINT": 3}.items() for x in kv])
    number = lambda t, k: F.expr("try_cast('' as int)") if t is None else F.when(t.rlike(r"^DECIMAL\("), F.regexp_extract(t, r"^DECIMAL\((\d+),(\d+)\)$", k)).try_cast("int")
    p, s, q, t = number(old, 1), number(old, 2), number(new, 1), number(new, 2)
    decimals = p.isNotNull() & q.isNotNull() & (old != new) & (t >= s) & (q - t >= p - s)
    from_whole = F.try_element_at(rank, old).isNotNull() & q.isNotNull() & (q - t >= F.when(old == "BIGINT", 20).otherwise(10))
    whole = F.try_element_at(rank, old) < F.try_element_at(rank, new)
    double = (new == "DOUBLE") & old.isin("TINYINT", "SMALLINT", "INT", "FLOAT")
    date = (old == "DATE") & (new == "TIMESTAMP_NTZ")
    return F.coalesce(decimals, F.lit(False)) | F.coalesce(from_whole, F.lit(False)) | F.coalesce(whole, F.lit(False)) | double | date


def _failure(df: DataFrame, order: int, rule: str, message: Column, subject: Column, details: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select("table_id", F.lit(order).alias("rule_ord"), "stream", "pos", F.lit(rule).alias("rule"), message.alias("message"), subject.alias("subject"), (none if details is None else details).alias("details"))


def operation() -> Column:
    """add, remove or change, per action."""
    a = F.col("action")
    adds = a.isin("CreateTable", "EnableTableFeature", "AddColumn", "SetPrimaryKey", "SetForeignKey") | (a.isin("SetProperty", "SetTableTag", "SetColumnTag") & F.col("old").isNull())
    removes = a.isin("UnsetProperty", "UnsetTableTag", "UnsetColumnTag", "DropColumn", "DropPrimaryKey", "DropForeignKey") | ((a == "AlterClustering") & (F.size("cols") == 0))
    return F.when(adds, "add").when(removes, "remove").otherwise("change")


def eligibility_failures(diff: DataFrame, d: dict[str, DataFrame], o: dict[str, DataFrame]) -> DataFrame:
    """Failures that no rule set can turn off; a table with one is not judged further."""
    scope = d["tables"].select("table_id", "scope")
    known = o["tables"].select("table_id", "kind")
    at = lambda df: df.withColumns({"stream": F.lit(0), "pos": F.lit(0).cast("long")})
    case = diff.where(F.col("action") == "ColumnCaseDrift")
    absent = scope.join(known, "table_id", "left_anti").where(F.col("scope") < MINIMUM_SCOPE["TABLE_EXISTENCE"])
    streaming = scope.join(known, "table_id").where((F.col("kind") == "STREAMING_TABLE") & (F.col("scope") > SCOPES["annotations"]))
    present = scope.join(known, "table_id", "left_semi")
    minimum = F.create_map(*[F.lit(x) for kv in MINIMUM_SCOPE.items() for x in kv])
    stray = diff.where(F.col("action") != "ColumnCaseDrift").join(present, "table_id").where(F.col("scope") < minimum[F.col("aspect")])
    symbol = F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv])[operation()]
    line = F.rtrim(F.concat_ws(" ", symbol, F.when(F.col("subject") != "", F.col("subject")), F.col("action")))
    grouped = stray.groupBy("table_id", "aspect").agg(
        F.min("stream").alias("stream"), F.min(F.struct("stream", "pos"))["pos"].alias("pos"),
        F.transform(F.sort_array(F.collect_list(F.struct("stream", "pos", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    label = F.lower(F.replace("aspect", F.lit("_"), F.lit(" ")))
    return (
        _failure(case, 1, "ColumnSpellingMustMatchCatalog", F.concat(F.lit("column "), F.col("col"), F.lit(" is spelled "), F.col("old"), F.lit(" in the catalog")), F.col("col"))
        .unionByName(_failure(at(absent), 2, "MissingTableUnmanaged", F.lit("the table does not exist and the scope does not create tables"), F.lit("")))
        .unionByName(_failure(at(streaming), 3, "StreamingTableAnnotationsOnly", F.lit("a streaming table takes comments and tags only; narrow the scope"), F.lit("")))
        .unionByName(_failure(grouped, 4, "UnmanagedAspectDrift", F.concat(F.lit("the scope does not manage "), label, F.lit(", which differs")), label, F.col("lines"))))


def safety_failures(diff: DataFrame, d: dict[str, DataFrame], o: dict[str, DataFrame]) -> DataFrame:
    """Failures of changes to existing tables."""
    drift = diff.join(o["tables"].select("table_id"), "table_id", "left_semi")
    declared = lambda key: d["properties"].where(F.col("key") == key).select("table_id", F.col("value").alias("setting"))
    of = lambda *actions: drift.where(F.col("action").isin(*actions))
    col = F.col("col")
    types = of("AlterColumnType").withColumn("wide", widening(F.col("old_sql"), F.col("type_sql")))
    change = F.concat(F.lit("column "), col, F.lit(": "), F.col("old_display"), F.lit(" → "), F.col("display"))
    unready = types.where("wide").join(declared(WIDENING), "table_id", "left").where(~F.col("setting").eqNullSafe(F.lit("true")))
    locked = F.lit(False)
    for key, pairs in TRANSITIONS.items():
        allowed = F.lit(False)
        for old, new in pairs:
            allowed = allowed | ((F.col("old") == old) & F.col("value").eqNullSafe(F.lit(new)))
        locked = locked | ((F.col("key") == key) & F.col("old").isNotNull() & ~allowed)
    drops = of("DropColumn").groupBy("table_id").agg(F.count("*").alias("n"), F.min("stream").alias("stream"), F.min("pos").alias("pos"))
    drops = drops.join(declared(MAPPING), "table_id", "left").where(~F.col("setting").eqNullSafe(F.lit("name")))
    dropped = of("DropForeignKey").select("table_id", "name", F.col("table_id").alias("owner"))
    holders = o["inbound"].join(dropped, ["table_id", "name", "owner"], "left_anti").groupBy("table_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("name", F.lit(" on "), "owner"))), ", ").alias("holders"))
    held = of("DropPrimaryKey").join(holders, "table_id")
    undeclared = F.concat(F.lit("property "), F.col("key"), F.lit(" is set on the table; declare it"), F.when(F.col("key").isin(*TRANSITIONS), ", it cannot be removed").otherwise(" or declare it absent"))
    parts = [
        _failure(of("AddColumn").where(~F.col("nullable")), 1, "NonNullableColumnAdd", F.concat(F.lit("column "), col, F.lit(" would be required in rows that lack it")), col),
        _failure(of("SetColumnNullability").where(~F.col("nullable")), 2, "NullabilityTighteningOnExistingColumn", F.concat(F.lit("column "), col, F.lit(" may hold nulls already")), col),
        _failure(types.where(~F.col("wide")), 3, "NonWideningColumnTypeChange", F.concat(change, F.lit(" is no widening")), col),
        _failure(unready, 4, "TypeWideningRequiredForTypeChange", F.concat(change, F.lit(f" needs {WIDENING}")), col),
        _failure(of("PartitioningChanged"), 5, "PartitioningChangeNotSupported", F.lit("the partitioning of an existing table cannot change"), F.lit("")),
        _failure(of("SetProperty", "UnsetProperty").where(locked), 6, "PropertyTransitionNotSupported", F.concat(F.lit("property "), F.col("key"), F.lit(" cannot change from "), F.col("old")), F.col("key")),
        _failure(of("PropertyUndeclared"), 7, "PropertyMustBeDeclared", undeclared, F.col("key")),
        _failure(drops, 8, "ColumnMappingRequiredForDrop", F.lit(f"dropping a column needs {MAPPING} = name"), F.lit("")),
        _failure(of("ColumnRenameConflict"), 9, "AmbiguousColumnRename", F.concat(col, F.lit(" is renamed to "), F.col("new"), F.lit(", and both exist")), col),
        _failure(held, 10, "PrimaryKeyReferencedByForeignKeys", F.concat(F.lit("the primary key is referenced by "), F.col("holders")), F.lit("")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def failures(diff: DataFrame, d: dict[str, DataFrame], o: dict[str, DataFrame], suppress: tuple[str, ...] = (), extra: tuple = ()) -> DataFrame:
    """All failures in report order. Tables that are not eligible show eligibility failures only.

    ``suppress`` names safety rules to skip. ``extra`` are further rules: functions of (diff, d, o) that return
    table_id, stream, pos, rule, message and subject of what they refuse.
    """
    first = settle(eligibility_failures(diff, d, o))
    then = safety_failures(diff, d, o)
    if suppress:
        then = then.where(~F.col("rule").isin(*suppress))
    for i, rule in enumerate(extra):
        found = rule(diff, d, o)
        none = F.array().cast("array<string>").alias("details")
        then = then.unionByName(found.select("table_id", F.lit(100 + i).alias("rule_ord"), "stream", "pos", "rule", "message", "subject", none))
    then = settle(then).join(first.select("table_id").distinct(), "table_id", "left_anti")
    return first.withColumn("eligible", F.lit(False)).unionByName(then.withColumn("eligible", F.lit(True)))


def foreign_key_verdicts(d: dict[str, DataFrame]) -> DataFrame:
    """Structural verdict of every managed foreign key, null if sound; cycles are judged with the table order.

    The first that holds: the parent is not declared, its columns are not the parent's key, types
    differ, spellings differ.
    """
    managed = d["tables"].where(F.col("scope") >= MINIMUM_SCOPE["FOREIGN_KEYS"]).select("table_id")
    keys = d["foreign_keys"].join(managed, "table_id", "left_semi")
    parents = d["tables"].select(F.col("table_id").alias("parent"), F.lit(True).alias("registered"))
    parent_keys = d["primary_keys"].select(F.col("table_id").alias("parent"), F.col("key").alias("parent_key"))
    pairs = keys.select("table_id", "ord", "parent", F.explode(F.arrays_zip("columns", "parent_columns")).alias("p"))
    pairs = pairs.select("table_id", "ord", "parent", F.lower("p.columns").alias("lk"), F.col("p.parent_columns").alias("spelled"))
    mine = d["columns"].select("table_id", F.col("k").alias("lk"), F.col("type_key").alias("mine"))
    theirs = d["columns"].select(F.col("table_id").alias("parent"), F.col("k").alias("pk"), F.col("type_key").alias("theirs"), F.col("name").alias("real"))
    judged = pairs.withColumn("pk", F.lower("spelled")).join(mine, ["table_id", "lk"], "left").join(theirs, ["parent", "pk"], "left")
    judged = judged.groupBy("table_id", "ord").agg(F.bool_or(F.col("mine") != F.col("theirs")).alias("types"), F.bool_or(F.col("spelled") != F.col("real")).alias("cases"))
    found = keys.join(parents, "parent", "left").join(parent_keys, "parent", "left").join(judged, ["table_id", "ord"])
    sorted_key = F.array_sort(F.transform("parent_columns", F.lower))
    reason = (
        F.when(F.col("registered").isNull(), "UNRESOLVABLE_REFERENCE")
        .when(~F.coalesce(sorted_key == F.col("parent_key"), F.lit(False)), "REFERENCED_COLUMNS_NOT_A_KEY")
        .when(F.col("types"), "REFERENCED_COLUMN_TYPE_MISMATCH")
        .when(F.col("cases"), "REFERENCED_COLUMN_CASE_MISMATCH"))
    return found.select("table_id", "ord", "columns", "parent", reason.alias("reason"))
