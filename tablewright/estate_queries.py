"""Registered queries over a hand-written estate that provokes every rule, action and outcome.

The SQL of each query starts from VALUES written here by hand, beside the declarations and states that the engine
gets, and never from the engine's own relations.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cli import load_declarations, redact
from .functions import types as kinds
from .operators.declare import PROPERTIES, SELF, BoundKey, Column, ForeignKey, Table, may_change
from .operators.differ import differences
from .operators.engine import Engine, ReadError, SyncFailed
from .operators.policy import failures, foreign_key_verdicts
from .operators.relations import Observed, ObservedColumn, relations
from .plans.graph import dependency_order
from .plans.report import _aligned, _detail, head
from .plans.statements import plan
from .schema import Array, Boolean, Date, Decimal, Integer, Long, Map, String, Struct, StructField, TimestampNtz, Variant
from .sources import information_schema as info
from .sources.catalog import SparkCatalog
from .sources.describe import MetadataError, parse_description

MODE, FEED, WIDE, LOGS = "delta.columnMapping.mode", "delta.enableChangeDataFeed", "delta.enableTypeWidening", "delta.logRetentionDuration"
ID = Column("id", Integer(), False)
SEEN_ID = ObservedColumn("id", Integer(), False)


def _table(name: str, *columns: Column, schema: str = "r", **more) -> Table:
    return Table("lake", schema, name, columns, **more)


def _seen(name: str, *columns: ObservedColumn, schema: str = "r", **more) -> Observed:
    return Observed(f"lake.{schema}.{name}", columns, **more)


def _relations(spark: SparkSession, declared, observed):
    return relations(spark, declared), relations(spark, observed)


class Fixed:
    """A reader of given states and an executor that fails at given statements."""

    def __init__(self, states, fails=()):
        self.states, self.fails, self.done = {s.table_id: s for s in states if isinstance(s, Observed)}, dict(fails), {}
        self.errors = {s[0]: s[1] for s in states if isinstance(s, tuple)}

    def read(self, table_ids):
        return {t: self.errors.get(t) or self.states.get(t) for t in table_ids}

    def execute(self, table, action):
        n = self.done[table.table_id] = self.done.get(table.table_id, 0) + 1
        if self.fails.get(table.table_id) == n:
            raise RuntimeError("refused")


# safety rules: one table for each, one that breaks two, and sound ones

RULED = [
    _table("v1", ID, Column("extra", String(), False)),
    _table("v2", ID, Column("a", String(), False)),
    _table("v3", ID, Column("a", String())),
    _table("v4", ID, Column("a", Long())),
    _table("v5", ID, Column("p", Date()), partitioned_by=["p"]),
    _table("v6", ID, properties={MODE: "none"}),
    _table("v7", ID),
    _table("v8", ID),
    _table("v9", ID, Column("fresh", String(), renamed_from="old"), properties={MODE: "name"}),
    _table("v10", ID),
    _table("two", ID, Column("a", Integer()), Column("b", String(), False)),
    _table("wide", ID, Column("a", Long()), properties={WIDE: "true"}),
    _table("mapped", ID, properties={MODE: "name"}),
    _table("relaxed", ID, Column("a", String())),
]
RULED_SEEN = [
    _seen("v1", SEEN_ID),
    _seen("v2", SEEN_ID, ObservedColumn("a", String())),
    _seen("v3", SEEN_ID, ObservedColumn("a", Integer())),
    _seen("v4", SEEN_ID, ObservedColumn("a", Integer())),
    _seen("v5", SEEN_ID, ObservedColumn("p", Date())),
    _seen("v6", SEEN_ID, properties={MODE: "name"}),
    _seen("v7", SEEN_ID, properties={LOGS: "interval 7 days"}),
    _seen("v8", SEEN_ID, ObservedColumn("gone", String())),
    _seen("v9", SEEN_ID, ObservedColumn("old", String()), ObservedColumn("fresh", String()), properties={MODE: "name"}),
    _seen("v10", SEEN_ID, primary_key=("v10_pk", ["id"]), inbound=[("child_fk", "lake.r.child")]),
    _seen("two", SEEN_ID, ObservedColumn("a", Long())),
    _seen("wide", SEEN_ID, ObservedColumn("a", Integer()), properties={WIDE: "true"}),
    _seen("mapped", SEEN_ID, ObservedColumn("gone", String()), properties={MODE: "name"}),
    _seen("relaxed", SEEN_ID, ObservedColumn("a", String(), False)),
]


def safety_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ten safety rules refuse."""
    d, o = _relations(spark, RULED, RULED_SEEN)
    return failures(differences(d, o), d, o).select("table_id", "rule", "subject")


SAFETY_SQL = f"""
WITH d(t, name, type, nullable, renamed_from) AS (VALUES
  ('v1', 'extra', 'STRING', false, NULL), ('v2', 'a', 'STRING', false, NULL), ('v3', 'a', 'STRING', true, NULL), ('v4', 'a', 'BIGINT', true, NULL), ('v5', 'p', 'DATE', true, NULL),
  ('v9', 'fresh', 'STRING', true, 'old'), ('two', 'a', 'INT', true, NULL), ('two', 'b', 'STRING', false, NULL), ('wide', 'a', 'BIGINT', true, NULL), ('relaxed', 'a', 'STRING', true, NULL)
), o(t, name, type, nullable) AS (VALUES
  ('v2', 'a', 'STRING', true), ('v3', 'a', 'INT', true), ('v4', 'a', 'INT', true), ('v5', 'p', 'DATE', true), ('v8', 'gone', 'STRING', true), ('v9', 'old', 'STRING', true),
  ('v9', 'fresh', 'STRING', true), ('two', 'a', 'BIGINT', true), ('wide', 'a', 'INT', true), ('mapped', 'gone', 'STRING', true), ('relaxed', 'a', 'STRING', false)
), dp(t, key, value) AS (VALUES ('v6', '{MODE}', 'none'), ('v9', '{MODE}', 'name'), ('wide', '{WIDE}', 'true'), ('mapped', '{MODE}', 'name')
), op(t, key, value) AS (VALUES ('v6', '{MODE}', 'name'), ('v7', '{LOGS}', 'interval 7 days'), ('v9', '{MODE}', 'name'), ('wide', '{WIDE}', 'true'), ('mapped', '{MODE}', 'name')
), parts(t, wanted, has) AS (VALUES ('v5', 'p', '')), keys(t, wanted, has) AS (VALUES ('v10', NULL, 'id')), inbound(t, name) AS (VALUES ('v10', 'child_fk')
), conflicts AS (SELECT d.t, d.renamed_from AS src FROM d JOIN o a ON a.t = d.t AND a.name = d.renamed_from JOIN o b ON b.t = d.t AND b.name = d.name
), gone AS (SELECT o.t FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.t = o.t AND d.name = o.name) AND NOT EXISTS (SELECT 1 FROM conflicts c WHERE c.t = o.t AND c.src = o.name)
), types AS (SELECT d.t, d.name, o.type = 'INT' AND d.type = 'BIGINT' AS wide FROM d JOIN o USING (t, name) WHERE d.type <> o.type
), found AS (
  SELECT t, 'NonNullableColumnAdd' AS rule, name AS subject FROM d WHERE NOT nullable AND NOT EXISTS (SELECT 1 FROM o WHERE o.t = d.t AND o.name = d.name)
  UNION ALL SELECT t, 'NullabilityTighteningOnExistingColumn', name FROM d JOIN o USING (t, name) WHERE o.nullable AND NOT d.nullable
  UNION ALL SELECT t, 'NonWideningColumnTypeChange', name FROM types WHERE NOT wide
  UNION ALL SELECT t, 'TypeWideningRequiredForTypeChange', name FROM types WHERE wide AND t NOT IN (SELECT t FROM dp WHERE key = '{WIDE}' AND value = 'true')
  UNION ALL SELECT t, 'PartitioningChangeNotSupported', '' FROM parts WHERE wanted <> has
  UNION ALL SELECT t, 'PropertyTransitionNotSupported', key FROM dp JOIN op USING (t, key) WHERE key = '{MODE}' AND dp.value <> op.value AND NOT (op.value = 'none' AND dp.value = 'name')
  UNION ALL SELECT t, 'PropertyMustBeDeclared', key FROM op WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.t = op.t AND dp.key = op.key)
  UNION ALL SELECT DISTINCT t, 'ColumnMappingRequiredForDrop', '' FROM gone WHERE t NOT IN (SELECT t FROM dp WHERE key = '{MODE}' AND value = 'name')
  UNION ALL SELECT t, 'AmbiguousColumnRename', src FROM conflicts
  UNION ALL SELECT DISTINCT t, 'PrimaryKeyReferencedByForeignKeys', '' FROM keys JOIN inbound USING (t) WHERE wanted IS DISTINCT FROM has
)
SELECT 'lake.r.' || t AS table_id, rule, subject FROM found
"""

# eligibility: what no rule set turns off

ELIGIBLE = [
    _table("e1", Column("Id", Integer())),
    _table("e2", ID, scope="annotations"),
    _table("e3", ID),
    _table("e4", ID, Column("added", String()), comment="new words", scope="tags"),
    _table("noted", ID, comment="new words", scope="annotations"),
    _table("absent", ID),
]
ELIGIBLE_SEEN = [_seen("e1", ObservedColumn("id", Integer())), _seen("e3", SEEN_ID, kind="STREAMING_TABLE"), _seen("e4", SEEN_ID, comment="old words"), _seen("noted", SEEN_ID, comment="old words")]


def eligibility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, o = _relations(spark, ELIGIBLE, ELIGIBLE_SEEN)
    return failures(differences(d, o), d, o).select("table_id", "rule", "subject", "eligible")


ELIGIBILITY_SQL = """
WITH d(t, scope) AS (VALUES ('e1', 4), ('e2', 2), ('e3', 4), ('e4', 1), ('noted', 2), ('absent', 4)), o(t, kind) AS (VALUES ('e1', 'TABLE'), ('e3', 'STREAMING_TABLE'), ('e4', 'TABLE'), ('noted', 'TABLE')
), spelled(t, declared, observed) AS (VALUES ('e1', 'Id', 'id')), drift(t, aspect, least) AS (VALUES ('e4', 'column structure', 4), ('e4', 'table comment', 2), ('noted', 'table comment', 2)
)
SELECT 'lake.r.' || t AS table_id, rule, subject, false AS eligible FROM (
  SELECT t, 'ColumnSpellingMustMatchCatalog' AS rule, declared AS subject FROM spelled WHERE lower(declared) = lower(observed) AND declared <> observed
  UNION ALL SELECT t, 'MissingTableUnmanaged', '' FROM d WHERE t NOT IN (SELECT t FROM o) AND scope < 4
  UNION ALL SELECT t, 'StreamingTableAnnotationsOnly', '' FROM d JOIN o USING (t) WHERE kind = 'STREAMING_TABLE' AND scope > 2
  UNION ALL SELECT t, 'UnmanagedAspectDrift', aspect FROM drift JOIN d USING (t) WHERE scope < least)
"""


def unmanaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines below a failure that tells of drift outside the scope."""
    report = Engine(spark, Fixed(ELIGIBLE_SEEN)).sync(*ELIGIBLE, dry_run=True)
    rows = [(t.name, f.extra["subject"], i, line) for t in report.tables for f in t.failures if f.extra.get("rule") == "UnmanagedAspectDrift" for i, line in enumerate(f.extra["details"])]
    return spark.createDataFrame(rows, "table_id string, subject string, place int, line string")


UNMANAGED_SQL = """
SELECT 'lake.r.e4' AS table_id, subject, CAST(place AS INTEGER) AS place, line FROM (VALUES ('column structure', 0, '+ added String'), ('table comment', 0, '~ table ''new words''')) AS v(subject, place, line)
"""

# all twenty actions: an existing table, an absent one, and a streaming table

PARENT = _table("parent", ID, schema="s", primary_key=["id"])
FULL = _table(
    "full", Column("id", Integer(), False), Column("named", String(), renamed_from="was"), Column("n", Long()), Column("at", TimestampNtz(), comment="it's new"),
    Column("free", String()), Column("kept", String(), comment="a \\ b", tags={"pii": "yes"}), Column("parent_id", Integer()), schema="s", comment="all of it", tags={"owner": "me"},
    properties={MODE: "name", WIDE: "true", FEED: "true", LOGS: None}, clustered_by=["n"], primary_key=["id"], primary_key_name="full_pk", foreign_keys=[ForeignKey("parent_id", PARENT, name="to_parent")])
FULL_SEEN = _seen(
    "full", SEEN_ID, ObservedColumn("was", String()), ObservedColumn("n", Integer()), ObservedColumn("free", String(), False), ObservedColumn("kept", String()), ObservedColumn("parent_id", Integer()),
    ObservedColumn("gone", String()), schema="s", comment="old", tags={"stale": "x"}, column_tags={"kept": {"tier": "1"}}, properties={MODE: "name", WIDE: "true", LOGS: "interval 1 day"},
    primary_key=("old_pk", ["n"]), foreign_keys=[BoundKey(("n",), "lake.s.parent", ("id",), "old_fk")])
FRESH = _table("fresh", ID, Column("b`c", Variant(), tags={"x": "1"}), schema="s", properties={MODE: "name", FEED: None}, tags={"t": "v"}, partitioned_by=["id"], primary_key=["id"],
               foreign_keys=[ForeignKey("id", SELF)])
FEED_TABLE = _table("feed", ID, Column("note", String(), comment="n"), schema="s", comment="c", scope="annotations", tags={"a": "b"})
FEED_SEEN = _seen("feed", SEEN_ID, ObservedColumn("note", String()), schema="s", kind="STREAMING_TABLE", column_tags={"note": {"k": "v"}})
ACTED, ACTED_SEEN = [PARENT, FULL, FRESH, FEED_TABLE], [_seen("parent", SEEN_ID, schema="s", primary_key=("parent_pk", ["id"])), FULL_SEEN, FEED_SEEN]


def all_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement of every kind of action, in plan order."""
    d, o = _relations(spark, ACTED, ACTED_SEEN)
    return plan(differences(d, o), d, o).select("table_id", "stmt_ord", "action", "statement")


# table, place, action and the text behind the table's name; the place follows the phase of the action and then the subject
_ACTS = [
    ("full", 1, "EnableTableFeature", "SET TBLPROPERTIES ('delta.feature.timestampNtz'='supported')"),
    ("full", 2, "SetProperty", f"SET TBLPROPERTIES ('{FEED}'='true')"),
    ("full", 3, "UnsetProperty", f"UNSET TBLPROPERTIES IF EXISTS ('{LOGS}')"),
    ("full", 4, "SetTableTag", "SET TAGS ('owner'='me')"),
    ("full", 5, "UnsetTableTag", "UNSET TAGS ('stale')"),
    ("full", 6, "DropForeignKey", "DROP CONSTRAINT IF EXISTS `old_fk`"),
    ("full", 7, "DropPrimaryKey", "DROP PRIMARY KEY IF EXISTS"),
    ("full", 8, "RenameColumn", "RENAME COLUMN `was` TO `named`"),
    ("full", 9, "AddColumn", "ADD COLUMN `at` TIMESTAMP_NTZ COMMENT 'it''s new'"),
    ("full", 10, "AlterColumnType", "ALTER COLUMN `n` TYPE BIGINT"),
    ("full", 11, "AlterClustering", "CLUSTER BY (`n`)"),
    ("full", 12, "SetColumnTag", "ALTER COLUMN `kept` SET TAGS ('pii'='yes')"),
    ("full", 13, "UnsetColumnTag", "ALTER COLUMN `kept` UNSET TAGS ('tier')"),
    ("full", 14, "DropColumn", "DROP COLUMN `gone`"),
    ("full", 15, "SetColumnComment", "ALTER COLUMN `kept` COMMENT 'a \\\\ b'"),
    ("full", 16, "SetTableComment", "COMMENT ON TABLE `lake`.`s`.`full` IS 'all of it'"),
    ("full", 17, "SetColumnNullability", "ALTER COLUMN `free` DROP NOT NULL"),
    ("full", 18, "SetPrimaryKey", "ADD CONSTRAINT `full_pk` PRIMARY KEY (`id`)"),
    ("full", 19, "SetForeignKey", "ADD CONSTRAINT `to_parent` FOREIGN KEY (`parent_id`) REFERENCES `lake`.`s`.`parent` (`id`)"),
    ("fresh", 1, "CreateTable", f"CREATE TABLE `lake`.`s`.`fresh` (`id` INT NOT NULL, `b``c` VARIANT, PRIMARY KEY (`id`)) USING delta TBLPROPERTIES ('{MODE}'='name') PARTITIONED BY (`id`)"),
    ("fresh", 2, "SetTableTag", "SET TAGS ('t'='v')"),
    ("fresh", 3, "SetColumnTag", "ALTER COLUMN `b``c` SET TAGS ('x'='1')"),
    ("fresh", 4, "SetForeignKey", "ADD FOREIGN KEY (`id`) REFERENCES `lake`.`s`.`fresh` (`id`)"),
    ("feed", 1, "SetTableTag", "SET TAGS ('a'='b')"),
    ("feed", 2, "UnsetColumnTag", "ALTER COLUMN `note` UNSET TAGS ('k')"),
    ("feed", 3, "SetColumnComment", "ALTER COLUMN `note` COMMENT 'n'"),
    ("feed", 4, "SetTableComment", "COMMENT ON TABLE `lake`.`s`.`feed` IS 'c'"),
]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ACTS_SQL = ", ".join(f"({_text(t)}, {n}, {_text(a)}, {_text(s)})" for t, n, a, s in _ACTS)
STATEMENTS_SQL = f"""
SELECT 'lake.s.' || t AS table_id, CAST(n AS INTEGER) AS stmt_ord, action,
  CASE WHEN action IN ('CreateTable', 'SetTableComment') THEN '' WHEN t = 'feed' THEN 'ALTER STREAMING TABLE `lake`.`s`.`feed` ' ELSE 'ALTER TABLE `lake`.`s`.`' || t || '` ' END || tail AS statement
FROM (VALUES {_ACTS_SQL}) AS v(t, n, action, tail)
"""


def difference_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the differences of one table are reported: features, renames, columns, layout, constraints, metadata."""
    diff = differences(*_relations(spark, ACTED, ACTED_SEEN)).where(F.col("table_id") == "lake.s.full")
    rows = [(i, r["action"]) for i, r in enumerate(diff.orderBy("stream", "pos").select("action").collect())]
    return spark.createDataFrame(rows, "place int, action string")


# columns in declared order with type, nullability, comment and tags of each, then removed ones
STREAM_SQL = """
WITH facts(stream, pos, action) AS (VALUES (1, 1, 'EnableTableFeature'), (2, 1, 'RenameColumn'), (3, 21, 'AlterColumnType'), (3, 30, 'AddColumn'), (3, 42, 'SetColumnNullability'), (3, 53, 'SetColumnComment'),
  (3, 54, 'SetColumnTag'), (3, 55, 'UnsetColumnTag'), (3, 90, 'DropColumn'), (4, 1, 'AlterClustering'), (5, 1, 'DropPrimaryKey'), (5, 2, 'SetPrimaryKey'), (5, 3, 'DropForeignKey'), (5, 4, 'SetForeignKey'),
  (6, 1, 'SetTableComment'), (6, 2, 'SetProperty'), (6, 3, 'UnsetProperty'), (6, 4, 'SetTableTag'), (6, 5, 'UnsetTableTag'))
SELECT CAST(row_number() OVER (ORDER BY stream, pos) - 1 AS INTEGER) AS place, action FROM facts
"""


def change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diff view of the same plan: category, operation, subject and detail."""
    report = Engine(spark, Fixed(ACTED_SEEN)).sync(*ACTED, dry_run=True)
    rows = [(t["name"], c["kind"], c["operation"], c["subject"], c["detail"]) for t in report.to_dict()["tables"] for c in t["changes"]]
    return spark.createDataFrame(rows, "table_id string, category string, operation string, subject string, detail string")


_LINES = [
    ("full", "features", "add", "timestampNtz", "— permanent protocol upgrade"), ("full", "properties", "add", FEED, "= 'true'"), ("full", "properties", "remove", LOGS, ""),
    ("full", "tags", "add", "owner", "= 'me'"), ("full", "tags", "remove", "stale", ""), ("full", "keys", "remove", "foreign key old_fk", ""), ("full", "keys", "remove", "primary key old_pk", ""),
    ("full", "columns", "change", "was", "renamed → named"), ("full", "columns", "add", "at", "TimestampNtz"), ("full", "comments", "add", "column at", "'it's new'"),
    ("full", "columns", "change", "n", "Integer → Long"), ("full", "clustering", "change", "clustering", "(n); rewrite the table to recluster existing rows"),
    ("full", "tags", "add", "column kept.pii", "= 'yes'"), ("full", "tags", "remove", "column kept.tier", ""), ("full", "columns", "remove", "gone", ""),
    ("full", "comments", "change", "column kept", "'a \\ b'"), ("full", "comments", "change", "table", "'all of it'"), ("full", "columns", "change", "free", "drop NOT NULL (was NOT NULL)"),
    ("full", "keys", "add", "primary key full_pk", "(id)"), ("full", "keys", "add", "foreign key to_parent", "(parent_id) → lake.s.parent"),
    ("fresh", "columns", "add", "id", "Integer NOT NULL"), ("fresh", "columns", "add", "b`c", "Variant"), ("fresh", "keys", "add", "primary key (id)", "(id)"),
    ("fresh", "partitioning", "add", "partitioning", "(id)"), ("fresh", "properties", "add", MODE, "= 'name'"), ("fresh", "tags", "add", "t", "= 'v'"),
    ("fresh", "tags", "add", "column b`c.x", "= '1'"), ("fresh", "keys", "add", "foreign key (id)", "(id) → lake.s.fresh"),
    ("feed", "tags", "add", "a", "= 'b'"), ("feed", "tags", "remove", "column note.k", ""), ("feed", "comments", "change", "column note", "'n'"), ("feed", "comments", "change", "table", "'c'"),
]
_LINES_SQL = "SELECT 'lake.s.' || t AS table_id, category, operation, subject, detail FROM (VALUES " + ", ".join("(" + ", ".join(map(_text, x)) + ")" for x in _LINES) + ") AS v(t, category, operation, subject, detail)"


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per category as the grid's last column counts them."""
    report = Engine(spark, Fixed(ACTED_SEEN)).sync(*ACTED, dry_run=True)
    return spark.createDataFrame([(t.name, _detail(t)) for t in report.tables], "table_id string, detail string")


CATEGORY_SQL = f"""
WITH c(category, place, one, many) AS (VALUES ('columns', 1, 'column', 'columns'), ('keys', 2, 'key', 'keys'), ('clustering', 3, 'clustering', 'clustering'), ('partitioning', 4, 'partitioning', 'partitioning'),
  ('features', 5, 'table feature', 'table features'), ('properties', 6, 'property', 'properties'), ('tags', 7, 'tag', 'tags'), ('comments', 8, 'comment', 'comments')
), n AS (SELECT table_id, category, count(*) AS n FROM ({_LINES_SQL}) GROUP BY ALL)
SELECT table_id, string_agg(n || ' ' || CASE WHEN n = 1 THEN one ELSE many END, ', ' ORDER BY place) AS detail FROM n JOIN c USING (category) GROUP BY table_id
UNION ALL SELECT 'lake.s.parent', 'no changes'
"""

# graphs: two cycles, one of them with a tail, and a table that refers to itself

_EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", "e"), ("g", "g"), ("h", "d"), ("i", "h"), ("i", "g")]


def cycle_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that reach each other along foreign keys."""
    _, cycles = dependency_order("abcdefghi", _EDGES)
    return spark.createDataFrame([(t, ",".join(sorted(group))) for t, group in cycles.items()], "table_id string, partners string")


_EDGES_SQL = "edges(c, p) AS (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in _EDGES) + ")"
CYCLES_SQL = f"""
WITH RECURSIVE {_EDGES_SQL}, reach(a, b) AS (SELECT c, p FROM edges WHERE c <> p UNION SELECT r.a, e.p FROM reach r JOIN edges e ON e.c = r.b WHERE e.c <> e.p)
SELECT x.a AS table_id, string_agg(x.b, ',' ORDER BY x.b) AS partners FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1
"""


def parents_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each foreign key outside cycles, whether the parent comes before the child."""
    order, cycles = dependency_order("abcdefghi", _EDGES)
    place = {t: i for i, t in enumerate(order)}
    rows = [(c, p, place[p] < place[c]) for c, p in _EDGES if c != p and p not in cycles.get(c, ())]
    return spark.createDataFrame(rows, "child string, parent string, first boolean")


PARENTS_SQL = f"""
WITH RECURSIVE {_EDGES_SQL}, reach(a, b) AS (SELECT c, p FROM edges WHERE c <> p UNION SELECT r.a, e.p FROM reach r JOIN edges e ON e.c = r.b WHERE e.c <> e.p)
SELECT c AS child, p AS parent, true AS first FROM edges WHERE c <> p AND NOT EXISTS (SELECT 1 FROM reach WHERE a = edges.p AND b = edges.c)
"""


def _judged_keys() -> list[Table]:
    make = lambda name, *columns, key=("id",), **more: Table("lake", "k", name, columns, primary_key=list(key) if key else None, **more)
    sound, lost = make("sound", ID), make("lost", ID)
    typed = make("typed", Column("id", Long(), False))
    spelled = make("spelled", Column("ID", Integer(), False), key=("ID",))
    other = make("other", ID, Column("second", Integer(), False))
    child = lambda name, parent, column, **more: make(name, ID, column, foreign_keys=[ForeignKey(column.name, parent)], **more)
    link = Column("link", Integer())
    return [
        sound, make("typed", ID), make("spelled", ID), make("other", ID, Column("second", Integer(), False), key=("second",)),
        child("c_sound", sound, link), child("c_lost", lost, link), child("c_typed", typed, Column("link", Long())), child("c_spelled", spelled, link), child("c_other", other, link),
        child("c_unmanaged", lost, link, scope="annotations"),
    ]


def key_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict on a foreign key; keys that the scope does not manage get none."""
    return foreign_key_verdicts(relations(spark, _judged_keys())).select("table_id", "parent", "reason")


VERDICTS_SQL = """
WITH registered(t, col, type, is_key) AS (VALUES ('sound', 'id', 'INT', true), ('typed', 'id', 'INT', true), ('spelled', 'id', 'INT', true), ('other', 'id', 'INT', false), ('other', 'second', 'INT', true)
), keys(t, scope, type, parent, col) AS (VALUES ('c_sound', 4, 'INT', 'sound', 'id'), ('c_lost', 4, 'INT', 'lost', 'id'), ('c_typed', 4, 'BIGINT', 'typed', 'id'), ('c_spelled', 4, 'INT', 'spelled', 'ID'),
  ('c_other', 4, 'INT', 'other', 'id'), ('c_other', 4, 'INT', 'other', 'second'), ('c_unmanaged', 2, 'INT', 'lost', 'id'))
SELECT DISTINCT 'lake.k.' || k.t AS table_id, 'lake.k.' || k.parent AS parent, CASE WHEN k.parent NOT IN (SELECT t FROM registered) THEN 'UNRESOLVABLE_REFERENCE'
  WHEN NOT r.is_key THEN 'REFERENCED_COLUMNS_NOT_A_KEY' WHEN r.type <> k.type THEN 'REFERENCED_COLUMN_TYPE_MISMATCH' WHEN r.col <> k.col THEN 'REFERENCED_COLUMN_CASE_MISMATCH' END AS reason
FROM keys k LEFT JOIN registered r ON r.t = k.parent AND lower(r.col) = lower(k.col) WHERE scope >= 3 AND NOT (k.t = 'c_other' AND k.col = 'second')
"""

# outcomes of a real run

_RUN = [
    _table("ok", ID, Column("a", String()), schema="x"), _table("same", ID, schema="x"), _table("unread", ID, schema="x"), _table("refused", ID, Column("a", String(), False), schema="x"),
    _table("half", ID, Column("a", String()), Column("b", String()), schema="x", primary_key=["id"]), _table("never", ID, Column("a", String()), schema="x"),
]
_RUN.append(_table("held", ID, Column("half_id", Integer()), schema="x", foreign_keys=[ForeignKey("half_id", _RUN[4])]))
_RUN.append(_table("stray", ID, Column("up", Integer()), schema="x", foreign_keys=[ForeignKey("up", PARENT)]))


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and change state of every table after a run that fails in every phase; -1 statements applied where nothing was executed."""
    states = [_seen(t.name, SEEN_ID, schema="x", primary_key=("pk", ["id"]) if t.name == "half" else None) for t in _RUN if t.name != "unread"]
    backend = Fixed([*states, ("lake.x.unread", ReadError("Unreadable", "no such place"))], {"lake.x.half": 2, "lake.x.never": 1})
    try:
        report = Engine(spark, backend, backend).sync(*_RUN)
    except SyncFailed as failed:
        report = failed.report
    rows = [(t.name, t.status, t.change_state(False), len(t.statements), -1 if t.applied is None else t.applied, t.bucket, t.failures[0].phase if t.failures else None) for t in report.tables]
    return spark.createDataFrame(rows, "table_id string, status string, change_state string, planned int, applied int, bucket string, phase string")


_RUN_FACTS = """
run(t, planned, unread, refused, stray, parent, fails_at) AS (VALUES ('ok', 1, false, false, false, NULL, NULL), ('same', 0, false, false, false, NULL, NULL), ('unread', 0, true, false, false, NULL, NULL),
  ('refused', 0, false, true, false, NULL, NULL), ('half', 2, false, false, false, NULL, 2), ('never', 1, false, false, false, NULL, 1), ('held', 2, false, false, false, 'half', NULL), ('stray', 2, false, false, true, NULL, NULL)
), failed AS (SELECT *, unread OR refused OR stray OR fails_at IS NOT NULL AS own FROM run
), held AS (SELECT a.*, b.own IS NOT NULL AND b.own AS blocked FROM failed a LEFT JOIN failed b ON b.t = a.parent
), judged AS (SELECT t, planned, CASE WHEN stray OR blocked THEN 'FOREIGN_KEY' WHEN unread THEN 'READ' WHEN refused THEN 'PLANNING' WHEN fails_at IS NOT NULL THEN 'EXECUTION' END AS phase,
  CASE WHEN stray OR blocked OR planned = 0 THEN NULL WHEN fails_at IS NOT NULL THEN fails_at - 1 ELSE planned END AS applied FROM held
), outcome AS (SELECT 'lake.x.' || t AS table_id, coalesce(phase || '_FAILED', 'SUCCESS') AS status, CASE WHEN planned = 0 THEN CASE WHEN phase IS NULL THEN 'unchanged' ELSE 'not planned' END
  WHEN coalesce(applied, 0) = 0 THEN 'not applied' WHEN applied = planned THEN 'applied' ELSE 'partially applied' END AS change_state, CAST(planned AS INTEGER) AS planned, CAST(coalesce(applied, -1) AS INTEGER) AS applied,
  CASE WHEN phase IS NOT NULL THEN 'failed' WHEN planned > 0 THEN 'changed' ELSE 'unchanged' END AS bucket, phase FROM judged)
"""
OUTCOMES_SQL = f"WITH {_RUN_FACTS} SELECT * FROM outcome"


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables per outcome and per change state."""
    found = run_outcomes(spark, sf_dir)
    by = lambda c: found.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(c))
    return by("bucket").unionByName(by("change_state")).select("kind", "name", "n")


COUNTS_SQL = f"WITH {_RUN_FACTS} SELECT 'bucket' AS kind, bucket AS name, count(*) AS n FROM outcome GROUP BY bucket UNION ALL SELECT 'change_state', change_state, count(*) FROM outcome GROUP BY change_state"

# descriptions of a catalog

_TYPES_OF = [("a", {"name": "int"}, True, None), ("b", {"name": "decimal", "precision": 12, "scale": 3}, False, "money"), ("c", {"name": "varchar", "length": 9}, True, ""), ("d", {"name": "timestamp_ltz"}, True, None),
             ("e", {"name": "array", "element_type": {"name": "long"}}, True, None), ("f", {"name": "map", "key_type": {"name": "string"}, "value_type": {"name": "real"}}, True, None)]
DOCUMENT = {
    "columns": [{"name": n, "type": t, "nullable": x} | ({} if c is None else {"comment": c}) for n, t, x, c in _TYPES_OF], "type": "MANAGED", "provider": "Delta", "comment": "words",
    "partition_columns": ["a"], "clustering_columns": None, "table_properties": {MODE: "name", "other": "x", "delta.feature.timestampNtz": "supported"},
}
_SPOILT = {
    "sound": {}, "external": {"type": "EXTERNAL"}, "stream": {"type": "STREAMING_TABLE"}, "view": {"type": "VIEW"}, "csv": {"provider": "csv"}, "no columns": {"columns": []}, "odd type": {"columns": [{"name": "a", "type": {"name": "interval"}}]},
    "odd layout": {"partition_columns": "a"}, "odd property": {"table_properties": {"k": 1}}, "odd nullable": {"columns": [{"name": "a", "type": {"name": "int"}, "nullable": "yes"}]}, "odd comment": {"comment": 5},
}
_DOCS = {name: json.dumps(DOCUMENT | more) for name, more in _SPOILT.items()}


def described_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = relations(spark, [parse_description(_DOCS["sound"], "lake.c.t")])
    return o["columns"].select(F.col("ord").cast("long").alias("ord"), "name", "type_sql", "nullable", "comment")


DESCRIBED_SQL = f"""
WITH doc AS (SELECT CAST({_text(_DOCS["sound"])} AS JSON) AS j), c AS (SELECT unnest(range(0, CAST(json_array_length(j, '$.columns') AS BIGINT))) AS ord, j FROM doc), x AS (
  SELECT ord, json_extract(j, '$.columns[' || ord || ']') AS c FROM c
), t AS (SELECT ord, c, c ->> '$.type.name' AS kind FROM x), names(kind, sql) AS (VALUES ('int', 'INT'), ('long', 'BIGINT'), ('string', 'STRING'), ('varchar', 'STRING'), ('real', 'FLOAT'), ('timestamp_ltz', 'TIMESTAMP'))
SELECT ord, c ->> '$.name' AS name, CASE kind WHEN 'decimal' THEN 'DECIMAL(' || (c ->> '$.type.precision') || ',' || (c ->> '$.type.scale') || ')'
    WHEN 'array' THEN 'ARRAY<' || (SELECT sql FROM names n WHERE n.kind = c ->> '$.type.element_type.name') || '>'
    WHEN 'map' THEN 'MAP<' || (SELECT sql FROM names n WHERE n.kind = c ->> '$.type.key_type.name') || ',' || (SELECT sql FROM names n WHERE n.kind = c ->> '$.type.value_type.name') || '>'
    ELSE (SELECT sql FROM names n WHERE n.kind = t.kind) END AS type_sql,
  CAST(c ->> '$.nullable' AS BOOLEAN) AS nullable, coalesce(c ->> '$.comment', '') AS comment FROM t
"""


def description_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which descriptions are tables that are managed, and of what kind."""
    rows = []
    for name, text in (*_DOCS.items(), ("no json", "{"), ("a list", "[]")):
        try:
            found = parse_description(text, "lake.c.t")
            rows.append((name, found.kind, ",".join(found.partitioned_by), found.comment))
        except MetadataError:
            rows.append((name, "MetadataError", None, None))
    return spark.createDataFrame(rows, "name string, kind string, partitioned_by string, comment string")


DESCRIPTION_SQL = f"""
WITH docs(name, j) AS (VALUES {", ".join(f"({_text(n)}, {_text(t)})" for n, t in _DOCS.items())}, ('no json', '{{'), ('a list', '[]')), v AS (
  SELECT name, CASE WHEN json_valid(j) THEN CAST(j AS JSON) ELSE CAST('{{}}' AS JSON) END AS j FROM docs
), ok AS (
  SELECT *, json_type(j, '$.columns') = 'ARRAY' AND json_array_length(j, '$.columns') > 0 AND (j ->> '$.type') IN ('MANAGED', 'EXTERNAL', 'STREAMING_TABLE') AND lower(j ->> '$.provider') = 'delta'
    AND coalesce(json_type(j, '$.partition_columns'), 'NULL') IN ('NULL', 'ARRAY') AND coalesce(json_type(j, '$.comment'), 'NULL') IN ('NULL', 'VARCHAR')
    AND coalesce(json_type(j, '$.table_properties.k'), 'VARCHAR') = 'VARCHAR' AND coalesce(json_type(j, '$.columns[0].nullable'), 'BOOLEAN') = 'BOOLEAN' AND (j ->> '$.columns[0].type.name') <> 'interval' AS sound FROM v
)
SELECT name, CASE WHEN NOT coalesce(sound, false) THEN 'MetadataError' WHEN (j ->> '$.type') = 'STREAMING_TABLE' THEN 'STREAMING_TABLE' ELSE 'TABLE' END AS kind,
  CASE WHEN sound THEN coalesce(j ->> '$.partition_columns[0]', '') END AS partitioned_by, CASE WHEN sound THEN coalesce(j ->> '$.comment', '') END AS comment FROM ok
"""


class _Missing(Exception):
    def getCondition(self):  # noqa: N802
        return "TABLE_OR_VIEW_NOT_FOUND"


class _Described(SparkCatalog):
    """A catalog whose descriptions are constants."""

    def __init__(self, spark: SparkSession, documents: dict[str, str], relations):
        super().__init__(spark, relations)
        self.documents = documents

    def describe(self, name: str) -> str | None:
        if "broken" in name:
            raise RuntimeError("no answer")
        if name not in self.documents:
            raise _Missing(name)
        return self.documents[name]


_KEYS = ["constraint_catalog", "constraint_schema", "constraint_name"]
_TABLE_OF = ["table_catalog", "table_schema", "table_name"]
_INFORMATION = {
    "schemata": (["schema_name"], [("C",)]),
    "table_constraints": ([*_KEYS, *_TABLE_OF, "constraint_type"], [("lake", "c", n, "lake", "C", t, k) for n, t, k in (
        ("t_pk", "T", "PRIMARY KEY"), ("t_u", "T", "UNIQUE"), ("t_fk", "T", "FOREIGN KEY"), ("u_pk", "u", "PRIMARY KEY"), ("u_fk", "u", "FOREIGN KEY"), ("u_un", "u", "FOREIGN KEY"))]),
    "key_column_usage": ([*_KEYS, *_TABLE_OF, "column_name", "ordinal_position", "position_in_unique_constraint"], [("lake", "c", n, "lake", "C", t, c, i, p) for n, t, c, i, p in (
        ("t_pk", "T", "b", 2, None), ("t_pk", "T", "a", 1, None), ("t_u", "T", "c", 1, None), ("t_fk", "T", "d", 1, 1), ("u_pk", "u", "x", 1, None), ("u_fk", "u", "p", 1, 2), ("u_fk", "u", "q", 2, 1), ("u_un", "u", "r", 1, 1))]),
    "referential_constraints": ([*_KEYS, *[f"unique_{c}" for c in _KEYS]], [("lake", "c", a, "lake", "c", b) for a, b in (("t_fk", "u_pk"), ("u_fk", "t_pk"), ("u_un", "t_u"))]),
    "table_tags": (["catalog_name", "schema_name", "table_name", "tag_name", "tag_value"], [("lake", "c", "t", "owner", "me"), ("lake", "c", "other", "owner", "you")]),
    "column_tags": (["catalog_name", "schema_name", "table_name", "column_name", "tag_name", "tag_value"], [("lake", "c", "t", "A", "pii", "no"), ("lake", "c", "u", "x", "pii", "yes")]),
}
_LONG = ("ordinal_position", "position_in_unique_constraint")


def _information(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in _LONG else 'string'}" for c in columns)) for name, (columns, rows) in _INFORMATION.items()}


def _cell(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else _text(x)


_INFORMATION_SQL = ", ".join(f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(_cell, r)) + ')' for r in rows)})" for name, (columns, rows) in _INFORMATION.items())


def catalog_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalog says of seven tables: state with keys and tags, absence, or an error."""
    documents = {"`lake`.`c`.`t`": _DOCS["sound"], "`lake`.`c`.`u`": _DOCS["stream"], "`lake`.`c`.`v`": _DOCS["view"], "`lake`.`c`.`empty`": ""}
    r = _information(spark)
    found = _Described(spark, documents, lambda _: r).read([f"lake.c.{t}" for t in ("t", "u", "v", "empty", "gone", "broken")] + ["lake.nowhere.t"])
    rows = []
    for t, s in found.items():
        if isinstance(s, Observed):
            keys = "; ".join(f"{k.name}({','.join(k.columns)})>{k.parent}({','.join(k.parent_columns)})" for k in s.foreign_keys)
            tags = ",".join([f"{k}={v}" for k, v in s.tags.items()] + [f"{c}.{k}={v}" for c, more in s.column_tags.items() for k, v in more.items()])
            rows.append((t, "present", s.kind, f"{s.primary_key[0]}({','.join(s.primary_key[1])})", keys, ",".join(f"{n}<{o}" for n, o in s.inbound), tags))
        else:
            rows.append((t, "absent" if s is None else s.exception_type, None, None, None, None, None))
    return spark.createDataFrame(rows, "table_id string, outcome string, kind string, primary_key string, foreign_keys string, inbound string, tags string")


CATALOG_SQL = f"""
WITH {_INFORMATION_SQL}, tables(t, schema_, kind, outcome) AS (VALUES ('t', 'c', 'TABLE', 'present'), ('u', 'c', 'STREAMING_TABLE', 'present'), ('v', 'c', NULL, 'MetadataError'), ('empty', 'c', NULL, 'MetadataError'),
  ('gone', 'c', NULL, NULL), ('broken', 'c', NULL, 'RuntimeError'), ('t', 'nowhere', NULL, NULL)
), pk AS (
  SELECT lower(c.table_name) AS t, constraint_name || '(' || string_agg(column_name, ',' ORDER BY ordinal_position) || ')' AS x FROM table_constraints c JOIN key_column_usage k USING (constraint_name)
  WHERE constraint_type = 'PRIMARY KEY' GROUP BY 1, constraint_name
), fk AS (
  SELECT lower(k.table_name) AS t, r.constraint_name || '(' || string_agg(k.column_name, ',' ORDER BY k.ordinal_position) || ')>lake.c.' || lower(any_value(p.table_name)) || '('
    || string_agg(p.column_name, ',' ORDER BY k.ordinal_position) || ')' AS x FROM referential_constraints r JOIN key_column_usage k ON k.constraint_name = r.constraint_name
    JOIN key_column_usage p ON p.constraint_name = r.unique_constraint_name AND p.ordinal_position = k.position_in_unique_constraint GROUP BY 1, r.constraint_name
), inbound AS (
  SELECT lower(u.table_name) AS t, string_agg(r.constraint_name || '<lake.c.' || lower(c.table_name), ',') AS x FROM referential_constraints r JOIN table_constraints u ON u.constraint_name = r.unique_constraint_name
  JOIN table_constraints c ON c.constraint_name = r.constraint_name WHERE u.constraint_type = 'PRIMARY KEY' GROUP BY 1
), tags AS (SELECT table_name AS t, tag_name || '=' || tag_value AS x, 1 AS place FROM table_tags UNION ALL SELECT table_name, lower(column_name) || '.' || tag_name || '=' || tag_value, 2 FROM column_tags)
SELECT 'lake.' || schema_ || '.' || tables.t AS table_id, coalesce(outcome, CASE WHEN schema_ IN (SELECT lower(schema_name) FROM schemata) THEN 'absent' ELSE 'MetadataError' END) AS outcome, kind,
  CASE WHEN kind IS NOT NULL THEN pk.x END AS primary_key, CASE WHEN kind IS NOT NULL THEN (SELECT string_agg(x, '; ' ORDER BY x) FROM fk WHERE fk.t = tables.t) END AS foreign_keys,
  CASE WHEN kind IS NOT NULL THEN inbound.x END AS inbound, CASE WHEN kind IS NOT NULL THEN (SELECT string_agg(x, ',' ORDER BY place, x) FROM tags WHERE tags.t = tables.t) END AS tags
FROM tables LEFT JOIN pk ON pk.t = tables.t LEFT JOIN inbound ON inbound.t = tables.t
"""


def info_table_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info.table_tags(_information(spark)["table_tags"], "lake", "c", "t")


def info_column_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info.column_tags(_information(spark)["column_tags"], "lake", "c", "t")


def info_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info.schema_exists(_information(spark)["schemata"], "c")


# types

_KINDS = [
    ({"name": "byte"}, "TINYINT", "Byte"), ({"name": "smallint"}, "SMALLINT", "Short"), ({"name": "integer"}, "INT", "Integer"), ({"name": "bigint"}, "BIGINT", "Long"), ({"name": "real"}, "FLOAT", "Float"),
    ({"name": "double"}, "DOUBLE", "Double"), ({"name": "boolean"}, "BOOLEAN", "Boolean"), ({"name": "char", "length": 3}, "STRING", "String"), ({"name": "binary"}, "BINARY", "Binary"), ({"name": "date"}, "DATE", "Date"),
    ({"name": "timestamp"}, "TIMESTAMP", "Timestamp"), ({"name": "timestamp_ntz"}, "TIMESTAMP_NTZ", "TimestampNtz"), ({"name": "variant"}, "VARIANT", "Variant"), ({"name": "numeric", "precision": 5, "scale": 0}, "DECIMAL(5,0)", "Decimal(5,0)"),
    ({"name": "decimal", "precision": 39, "scale": 0}, None, None), ({"name": "string", "collation": "UTF8_LCASE"}, None, None), ({"name": "interval"}, None, None), ({"name": "struct", "fields": []}, None, None),
    ({"name": "struct", "fields": [{"name": "a", "type": {"name": "int"}, "nullable": False}, {"name": "b c", "type": {"name": "date"}}]}, "STRUCT<`a`: INT NOT NULL, `b c`: DATE>", "Struct<a: Integer NOT NULL, b c: Date>"),
    ({"name": "map", "key_type": {"name": "map", "key_type": {"name": "int"}, "value_type": {"name": "int"}}, "value_type": {"name": "int"}}, None, None),
    ({"name": "array", "element_type": {"name": "map", "key_type": {"name": "int"}, "value_type": {"name": "string"}}}, "ARRAY<MAP<INT,STRING>>", "Array<Map<Integer, String>>"),
]


def type_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text and display text of types in catalog documents; null where a type is not supported."""
    rows = []
    for doc, _, _ in _KINDS:
        kind = kinds.from_document(doc)
        rows.append((json.dumps(doc), None if kind is None else kinds.render(kind), None if kind is None else kinds.display(kind)))
    return spark.createDataFrame(rows, "document string, type_sql string, display string")


TYPES_SQL = "SELECT document, CAST(type_sql AS VARCHAR) AS type_sql, CAST(display AS VARCHAR) AS display FROM (VALUES " + ", ".join(f"({_text(json.dumps(d))}, {_cell(s)}, {_cell(x)})" for d, s, x in _KINDS) + ") AS v(document, type_sql, display)"

# properties and declarations

_VALUES = ["true", "false", "True", "none", "name", "id", "interval 7 days", "interval 1 week", "interval 7", "7 days", "-1", "0", "32", "032", "-2"]


def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which values a declaration may give each managed property."""
    rows = []
    for key in PROPERTIES:
        for value in _VALUES:
            try:
                _table("p", ID, properties={key: value})
                rows.append((key, value))
            except ValueError:
                pass
    return spark.createDataFrame(rows, "key string, value string")


PROPERTY_SQL = f"""
WITH k(key, kind) AS (VALUES ('{MODE}', 'mode'), ('{FEED}', 'flag'), ('{WIDE}', 'flag'), ('{LOGS}', 'span'), ('delta.deletedFileRetentionDuration', 'span'), ('delta.dataSkippingNumIndexedCols', 'count')
), v AS (SELECT unnest([{", ".join(map(_text, _VALUES))}]) AS value)
SELECT key, value FROM k, v WHERE CASE kind WHEN 'mode' THEN value IN ('none', 'name') WHEN 'flag' THEN value IN ('true', 'false')
  WHEN 'span' THEN regexp_full_match(value, 'interval \\d+ (nanosecond|microsecond|millisecond|second|minute|hour|day|week)s?')
  ELSE TRY_CAST(value AS INTEGER) >= -1 AND CAST(TRY_CAST(value AS INTEGER) AS VARCHAR) = value END
"""


def property_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = (None, "none", "name")
    rows = [(key, old, new) for key in (MODE, FEED) for old in modes for new in modes if may_change(key, old, new)]
    return spark.createDataFrame(rows, "key string, old string, new string")


TRANSITION_SQL = f"""
WITH m(x) AS (VALUES (CAST(NULL AS VARCHAR)), ('none'), ('name')), k(key) AS (VALUES ('{MODE}'), ('{FEED}'))
SELECT key, a.x AS old, b.x AS new FROM k, m a, m b WHERE key <> '{MODE}' OR a.x IS NULL OR a.x IS NOT DISTINCT FROM b.x OR (a.x = 'none' AND b.x = 'name')
"""
_NESTED = Struct([StructField("x", Integer(), False)])
_DECLARED: list[tuple[str, bool, Callable[[], object]]] = [
    ("no column", False, lambda: _table("t")), ("one column", True, lambda: _table("t", ID)), ("same name twice", False, lambda: _table("t", ID, Column("ID", Integer()))),
    ("blank column", False, lambda: Column(" ", Integer())), ("dotted table", False, lambda: _table("a.b", ID)), ("255 characters", True, lambda: _table("a" * 255, ID)), ("256 characters", False, lambda: _table("a" * 256, ID)),
    ("special name", False, lambda: _table("t", Column("a b", Integer()))), ("special name, mapped", True, lambda: _table("t", Column("a b", Integer()), properties={MODE: "name"})),
    ("special name, tags only", True, lambda: _table("t", Column("a b", Integer()), scope="tags")),
    ("reserved name", False, lambda: _table("t", Column("_change_type", Integer()), properties={FEED: "true"})), ("reserved name, no feed", True, lambda: _table("t", Column("_change_type", Integer()))),
    ("unknown property", False, lambda: _table("t", ID, properties={"x": "y"})), ("property absent", True, lambda: _table("t", ID, properties={FEED: None})),
    ("cluster and partition", False, lambda: _table("t", ID, Column("a", Integer()), partitioned_by=["a"], clustered_by=["id"])), ("cluster by five", False, lambda: _table("t", *[Column(x, Integer()) for x in "abcde"], clustered_by=list("abcde"))),
    ("cluster by boolean", False, lambda: _table("t", ID, Column("a", Boolean()), clustered_by=["a"])), ("partition by boolean", True, lambda: _table("t", ID, Column("a", Boolean()), partitioned_by=["a"])),
    ("partition by array", False, lambda: _table("t", ID, Column("a", Array(Integer())), partitioned_by=["a"])), ("partition by all", False, lambda: _table("t", ID, partitioned_by=["id"])),
    ("layout as text", False, lambda: _table("t", ID, clustered_by="id")), ("layout spelled otherwise", False, lambda: _table("t", ID, clustered_by=["ID"])),
    ("rename", True, lambda: _table("t", Column("a", Integer(), renamed_from="b"), properties={MODE: "name"})), ("rename unmapped", False, lambda: _table("t", Column("a", Integer(), renamed_from="b"))),
    ("rename from itself", False, lambda: Column("a", Integer(), renamed_from="A")), ("rename of a declared column", False, lambda: _table("t", ID, Column("a", Integer(), renamed_from="id"), properties={MODE: "name"})),
    ("50 tags", True, lambda: _table("t", ID, tags={str(i): "x" for i in range(50)})), ("51 tags", False, lambda: _table("t", ID, tags={str(i): "x" for i in range(51)})),
    ("long tag", False, lambda: _table("t", ID, tags={"a" * 257: "x"})), ("tag value of 256", True, lambda: _table("t", ID, tags={"a": "x" * 256})), ("blank tag", False, lambda: Column("a", Integer(), tags={" ": "x"})),
    ("required in optional struct", False, lambda: _table("t", Column("a", _NESTED))), ("required in required struct", True, lambda: _table("t", Column("a", _NESTED, False))),
    ("required in array", False, lambda: _table("t", Column("a", Array(_NESTED), False))), ("required in map", False, lambda: _table("t", Column("a", Map(String(), _NESTED), False))),
    ("key of nullable column", False, lambda: _table("t", Column("a", Integer()), primary_key=["a"])), ("key as text", False, lambda: _table("t", ID, primary_key="id")), ("empty key", False, lambda: _table("t", ID, primary_key=[])),
    ("key named", True, lambda: _table("t", ID, primary_key=["id"], primary_key_name="k")), ("name without key", False, lambda: _table("t", ID, primary_key_name="k")), ("key of no column", False, lambda: _table("t", ID, primary_key=["x"])),
    ("foreign key to itself", True, lambda: _table("t", ID, Column("up", Integer()), primary_key=["id"], foreign_keys=[ForeignKey("up", SELF)])), ("foreign key without parent key", False, lambda: _table("t", ID, foreign_keys=[ForeignKey("id", _table("p", ID))])),
    ("foreign key of other type", False, lambda: _table("t", Column("a", Long()), foreign_keys=[ForeignKey("a", PARENT)])), ("foreign key of no column", False, lambda: _table("t", ID, foreign_keys=[ForeignKey("x", PARENT)])),
    ("two keys on a column", False, lambda: _table("t", ID, foreign_keys=[ForeignKey("id", PARENT), ForeignKey("id", PARENT)])), ("foreign key alone", False, lambda: _table("t", ID, foreign_keys=ForeignKey("id", PARENT))),
    ("other catalog", False, lambda: Table("sea", "s", "t", [ID], foreign_keys=[ForeignKey("id", PARENT)])), ("decimal of 39", False, lambda: Column("a", Decimal(39, 0))), ("map of maps", False, lambda: Column("a", Map(Map(Integer(), Integer()), Integer()))),
    ("unknown scope", False, lambda: _table("t", ID, scope="all")),
]


def declarations_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which declarations are refused when they are made."""
    rows = []
    for name, _, make in _DECLARED:
        try:
            make()
            rows.append((name, True))
        except (TypeError, ValueError):
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, accepted boolean")


DECLARED_SQL = "SELECT name, accepted FROM (VALUES " + ", ".join(f"({_text(n)}, {str(ok).lower()})" for n, ok, _ in _DECLARED) + ") AS v(name, accepted)"

# texts and references

TABLES = [_table("one", ID), _table("two", ID)]
EMPTY: list[Table] = []


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message heads, aligned columns, and secrets hidden."""
    os.environ["TABLEWRIGHT_QUERY_TOKEN"] = "s3cr3t"
    try:
        hidden = redact("with s3cr3t in it")
    finally:
        del os.environ["TABLEWRIGHT_QUERY_TOKEN"]
    rows = [("head", head("\n".join("abcdefg"))), ("padded", "|".join(_aligned([("a", "bb", "c"), ("aaa", "b", "cc")]))), ("redacted", hidden)]
    return spark.createDataFrame(rows, "form string, text string")


TEXT_SQL = """
SELECT 'head' AS form, array_to_string(string_split('a b c d e f g', ' ')[1:5], chr(10)) AS text
UNION ALL SELECT 'padded', rpad('a', 3, ' ') || '  ' || rpad('bb', 2, ' ') || '  c|' || rpad('aaa', 3, ' ') || '  ' || rpad('b', 2, ' ') || '  cc'
UNION ALL SELECT 'redacted', replace('with s3cr3t in it', 's3cr3t', '***')
"""


def references_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What declarations a reference on the command line gives."""
    rows = []
    for reference in ("tablewright.estate_queries:TABLES", "tablewright.estate_queries:PARENT", "tablewright.estate_queries:EMPTY", "tablewright.estate_queries", "tablewright.estate_queries:", ":TABLES", "tablewright.estate_queries:NOTHING"):
        try:
            rows.append((reference, ",".join(t.name for t in load_declarations(reference))))
        except (AttributeError, ValueError) as e:
            rows.append((reference, type(e).__name__))
    return spark.createDataFrame(rows, "reference string, found string")


REFERENCES_SQL = """
SELECT 'tablewright.estate_queries' || tail AS reference, found FROM (VALUES (':TABLES', 'one,two'), (':PARENT', 'parent'), (':EMPTY', 'ValueError'), ('', 'ValueError'), (':', 'ValueError'), (':NOTHING', 'AttributeError')) AS v(tail, found)
UNION ALL SELECT ':TABLES', 'ValueError'
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        safety_rules, eligibility_rules, unmanaged_lines, all_statements, difference_stream, change_lines, category_counts, cycle_partners, parents_first, key_verdicts, run_outcomes, run_counts, described_columns,
        description_outcomes, catalog_state, info_table_tags, info_column_tags, info_schema, type_texts, property_values, property_transitions, declarations_accepted, text_forms, references_loaded)
}
ORACLES: dict[str, str] = {
    "safety_rules": SAFETY_SQL, "eligibility_rules": ELIGIBILITY_SQL, "unmanaged_lines": UNMANAGED_SQL, "all_statements": STATEMENTS_SQL, "difference_stream": STREAM_SQL, "change_lines": _LINES_SQL,
    "category_counts": CATEGORY_SQL, "cycle_partners": CYCLES_SQL, "parents_first": PARENTS_SQL, "key_verdicts": VERDICTS_SQL, "run_outcomes": OUTCOMES_SQL, "run_counts": COUNTS_SQL, "described_columns": DESCRIBED_SQL,
    "description_outcomes": DESCRIPTION_SQL, "catalog_state": CATALOG_SQL, "info_table_tags": f"WITH {_INFORMATION_SQL} SELECT tag_name, tag_value FROM table_tags WHERE table_name = 't'",
    "info_column_tags": f"WITH {_INFORMATION_SQL} SELECT column_name, tag_name, tag_value FROM column_tags WHERE table_name = 't'",
    "info_schema": f"WITH {_INFORMATION_SQL} SELECT schema_name FROM schemata WHERE lower(schema_name) = 'c'", "type_texts": TYPES_SQL, "property_values": PROPERTY_SQL, "property_transitions": TRANSITION_SQL,
    "declarations_accepted": DECLARED_SQL, "text_forms": TEXT_SQL, "references_loaded": REFERENCES_SQL,
}
