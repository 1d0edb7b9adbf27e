import random

import pytest
from pyspark.sql import functions as F

from tablewright import Engine, ReadError, SyncFailed
from tablewright.functions import types as kinds
from tablewright.operators.declare import BoundKey, Column, ForeignKey, Table
from tablewright.operators.differ import PHASES, differences
from tablewright.operators.engine import DuplicateTable
from tablewright.operators.policy import failures, widening
from tablewright.operators.relations import Observed, ObservedColumn, relations
from tablewright.plans.graph import blocked, components, dependency_order
from tablewright.plans.statements import plan
from tablewright.queries import _ALL_TYPES
from tablewright.schema import Array, Date, Decimal, Double, Float, Integer, Long, String, Struct, StructField, TimestampNtz, Variant
from tablewright.errors import condition
from tablewright.sources.catalog import SparkCatalog, run_statement
from tablewright.sources.describe import MetadataError, parse_description
from tablewright.sources.files import workspace
from tablewright.sources.local_store import Conflict, LocalStore

MAPPED = {"delta.columnMapping.mode": "name"}
WIDE = MAPPED | {"delta.enableTypeWidening": "true"}


def make(name, *columns, **options):
    return Table("c", "s", name, columns, **options)


def seen(name, *columns, **options):
    return Observed(f"c.s.{name}", [ObservedColumn(c.name, c.type, c.nullable, c.comment) for c in columns], **options)


ID, NAME = Column("id", Integer(), False), Column("name", String())

# one table for each situation, so that one relational pass answers all of them
CASES = {
    "same": (make("same", ID, NAME), seen("same", NAME, ID)),
    "new": (make("new", ID, Column("n", String(), comment="it's", tags={"pii": "y"}), primary_key=["id"], tags={"o": "1"}, comment="c\\"), None),
    "ren": (make("ren", ID, Column("title", String(), renamed_from="name", tags={"k": "2"}), properties=MAPPED, clustered_by=["title"], primary_key=["id"]),
            seen("ren", ID, NAME, properties=MAPPED, clustered_by=["name"], column_tags={"name": {"k": "1"}}, primary_key=("pk", ["id"]))),
    "renkey": (make("renkey", Column("key", Integer(), False, renamed_from="id"), properties=MAPPED, primary_key=["key"]), seen("renkey", ID, properties=MAPPED, primary_key=("pk", ["id"]))),
    "both": (make("both", ID, Column("title", String(), renamed_from="name"), properties=MAPPED), seen("both", ID, NAME, Column("title", String()), properties=MAPPED)),
    "inert": (make("inert", ID, Column("title", String(), renamed_from="name"), properties=MAPPED), seen("inert", ID, Column("title", String()), properties=MAPPED)),
    "types": (make("types", Column("a", Long()), Column("b", Integer()), Column("c", Decimal(12, 3)), Column("d", TimestampNtz()), properties=WIDE),
              seen("types", Column("a", Integer()), Column("b", Long()), Column("c", Decimal(10, 2)), Column("d", Date()), properties=WIDE)),
    "unready": (make("unready", Column("a", Long())), seen("unready", Column("a", Integer()))),
    "tight": (make("tight", ID, Column("b", String(), False)), seen("tight", Column("id", Integer()))),
    "loose": (make("loose", Column("id", Integer()), NAME), seen("loose", ID, NAME)),
    "drop": (make("drop", ID), seen("drop", ID, NAME, column_tags={"name": {"x": "1"}})),
    "part": (make("part", ID, NAME, Column("z", String()), partitioned_by=["name", "z"]), seen("part", ID, NAME, Column("z", String()), partitioned_by=["z", "name"])),
    "clus": (make("clus", ID, NAME, clustered_by=["name", "id"]), seen("clus", ID, NAME, clustered_by=["id", "name"])),
    "prop": (make("prop", ID, properties={"delta.columnMapping.mode": "none", "delta.enableChangeDataFeed": None}),
             seen("prop", ID, properties={"delta.columnMapping.mode": "name", "delta.enableChangeDataFeed": "true", "delta.logRetentionDuration": "interval 1 day", "unmanaged": "1"})),
    "case": (make("case", Column("ID", Integer(), False), Column("n", String(), False)), seen("case", ID)),
    "feat": (make("feat", ID, Column("v", Array(Struct([StructField("x", Variant())])))), seen("feat", ID, Column("v", Array(Struct([StructField("X", Variant())]))))),
    "hasfeat": (make("hasfeat", Column("t", TimestampNtz())), seen("hasfeat", Column("t", TimestampNtz()), properties={"delta.feature.timestampNtz": "supported"})),
    "keydrop": (make("keydrop", ID), seen("keydrop", ID, primary_key=("pk", ["id"]), inbound=[("x_fk", "c.s.x")])),
    "keyself": (make("keyself", ID, NAME), seen("keyself", ID, NAME, primary_key=("pk", ["id"]), inbound=[("own", "c.s.keyself")],
                                               foreign_keys=[BoundKey(("id",), "c.s.keyself", ("id",), "own"), BoundKey(("id",), "c.s.keyself", ("id",), "own2")])),
    "scoped": (make("scoped", ID, NAME, scope="tags", tags={"a": "1"}, comment="new"), seen("scoped", ID, comment="old")),
    "absent": (make("absent", ID, scope="metadata"), None),
    "stream": (make("stream", ID, scope="metadata"), seen("stream", ID, kind="STREAMING_TABLE")),
    "annot": (make("annot", Column("id", Integer(), False, comment="c", tags={"t": "1"}), scope="annotations", tags={"a": "1"}, comment="x"), seen("annot", ID, kind="STREAMING_TABLE")),
}


@pytest.fixture(scope="module")
def judged(spark):
    d = relations(spark, [t for t, _ in CASES.values()])
    o = relations(spark, [s for _, s in CASES.values() if s])
    diff = differences(d, o)
    diffs, fails, plans = {}, {}, {}
    for r in diff.orderBy("stream", "pos").collect():
        diffs.setdefault(r.table_id[4:], []).append((r.action, r.subject))
    for r in failures(diff, d, o).orderBy("table_id", "eligible", "rule_ord", "stream", "pos").collect():
        fails.setdefault(r.table_id[4:], []).append((r.rule, r.subject))
    for r in plan(diff, d, o).orderBy("table_id", "stmt_ord").collect():
        plans.setdefault(r.table_id[4:], []).append(r.statement)
    return diffs, fails, plans


WANTED = {
    "same": None, "inert": None, "clus": None, "hasfeat": None,
    "new": [("CreateTable", ""), ("SetTableTag", "o"), ("SetColumnTag", "n.pii")],
    "ren": [("RenameColumn", "name"), ("SetColumnTag", "title.k")],
    "renkey": [("RenameColumn", "id"), ("DropPrimaryKey", "pk"), ("SetPrimaryKey", "key")],
    "both": [("ColumnRenameConflict", "name")],
    "types": [("EnableTableFeature", "timestampNtz"), ("AlterColumnType", "a"), ("AlterColumnType", "b"), ("AlterColumnType", "c"), ("AlterColumnType", "d")],
    "tight": [("SetColumnNullability", "id"), ("AddColumn", "b")],
    "loose": [("SetColumnNullability", "id")],
    "drop": [("UnsetColumnTag", "name.x"), ("DropColumn", "name")],
    "part": [("PartitioningChanged", "")],
    "prop": [("SetProperty", "delta.columnMapping.mode"), ("UnsetProperty", "delta.enableChangeDataFeed"), ("PropertyUndeclared", "delta.logRetentionDuration")],
    "feat": [("EnableTableFeature", "variantType")],
    "keydrop": [("DropPrimaryKey", "pk")],
    "keyself": [("DropPrimaryKey", "pk"), ("DropForeignKey", "own"), ("DropForeignKey", "own2")],
    "scoped": [("AddColumn", "name"), ("SetTableComment", ""), ("SetTableTag", "a")],
    "absent": [("CreateTable", "")],
    "annot": [("SetColumnComment", "id"), ("SetColumnTag", "id.t"), ("SetTableComment", ""), ("SetTableTag", "a")],
}


@pytest.mark.parametrize("name", list(WANTED))
def test_differences(judged, name):
    assert judged[0].get(name) == WANTED[name]


RULES = {
    "new": None, "ren": None, "renkey": None, "loose": None, "annot": None, "keyself": None,
    "both": [("AmbiguousColumnRename", "name")],
    "types": [("NonWideningColumnTypeChange", "b")],
    "unready": [("TypeWideningRequiredForTypeChange", "a")],
    "tight": [("NonNullableColumnAdd", "b"), ("NullabilityTighteningOnExistingColumn", "id")],
    "drop": [("ColumnMappingRequiredForDrop", "")],
    "part": [("PartitioningChangeNotSupported", "")],
    "prop": [("PropertyTransitionNotSupported", "delta.columnMapping.mode"), ("PropertyMustBeDeclared", "delta.logRetentionDuration")],
    "case": [("ColumnSpellingMustMatchCatalog", "ID")],
    "keydrop": [("PrimaryKeyReferencedByForeignKeys", "")],
    "scoped": [("UnmanagedAspectDrift", "column structure"), ("UnmanagedAspectDrift", "table comment")],
    "absent": [("MissingTableUnmanaged", "")],
    "stream": [("StreamingTableAnnotationsOnly", "")],
}


@pytest.mark.parametrize("name", RULES)
def test_policy(judged, name):
    assert judged[1].get(name) == RULES[name]


def test_statements(judged):
    plans = judged[2]
    assert plans["new"] == [
        "CREATE TABLE `c`.`s`.`new` (`id` INT NOT NULL, `n` STRING COMMENT 'it''s', PRIMARY KEY (`id`)) USING delta COMMENT 'c\\\\'",
        "ALTER TABLE `c`.`s`.`new` SET TAGS ('o'='1')", "ALTER TABLE `c`.`s`.`new` ALTER COLUMN `n` SET TAGS ('pii'='y')"]
    assert plans["renkey"] == ["ALTER TABLE `c`.`s`.`renkey` DROP PRIMARY KEY IF EXISTS", "ALTER TABLE `c`.`s`.`renkey` RENAME COLUMN `id` TO `key`", "ALTER TABLE `c`.`s`.`renkey` ADD PRIMARY KEY (`key`)"]
    assert plans["annot"] == [
        "ALTER STREAMING TABLE `c`.`s`.`annot` SET TAGS ('a'='1')", "ALTER STREAMING TABLE `c`.`s`.`annot` ALTER COLUMN `id` SET TAGS ('t'='1')",
        "ALTER STREAMING TABLE `c`.`s`.`annot` ALTER COLUMN `id` COMMENT 'c'", "COMMENT ON TABLE `c`.`s`.`annot` IS 'x'"]
    assert plans["feat"] == ["ALTER TABLE `c`.`s`.`feat` SET TBLPROPERTIES ('delta.feature.variantType-preview'='supported')"]
    assert plans["drop"] == ["ALTER TABLE `c`.`s`.`drop` ALTER COLUMN `name` UNSET TAGS ('x')", "ALTER TABLE `c`.`s`.`drop` DROP COLUMN `name`"]
    assert plans["loose"] == ["ALTER TABLE `c`.`s`.`loose` ALTER COLUMN `id` DROP NOT NULL"]
    assert plans["prop"][-1] == "ALTER TABLE `c`.`s`.`prop` UNSET TBLPROPERTIES IF EXISTS ('delta.enableChangeDataFeed')"
    assert len(PHASES) == 20


def test_widening_column_equals_python(spark):
    docs = {"TINYINT": "tinyint", "SMALLINT": "smallint", "INT": "int", "BIGINT": "bigint", "STRING": "string"}
    made = {t: kinds.from_document({"name": docs.get(t, t.lower().split("(")[0]), "precision": int(t[8:10]), "scale": int(t[11:-1])} if t.startswith("DECIMAL") else
                                   {"name": docs.get(t, t.lower())}) or Array(Integer()) for t in _ALL_TYPES}
    pairs = [(a, b) for a in made for b in made]
    got = {(r.a, r.b): r.w for r in spark.createDataFrame(pairs, "a string, b string").withColumn("w", widening(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b): kinds.widens(made[a], made[b]) for a, b in pairs}
    assert kinds.widens(Float(), Double()) and not kinds.widens(Long(), Double())


def test_order_of_deep_chains_and_cycles():
    names = [f"t{i:05d}" for i in range(3000)]
    random.Random(1).shuffle(names)
    chain = list(zip(names[1:], names[:-1], strict=True))
    order, cycles = dependency_order(names, chain)
    assert order == names and not cycles
    order, cycles = dependency_order(names, [*chain, (names[0], names[-1])])
    assert sorted(order) == sorted(names) and all(len(cycles[n]) == 3000 for n in names)
    assert dependency_order(["b", "a"], [("a", "a")])[0] == ["a", "b"]
    assert components(["a", "b", "c"], {"a": ["b"], "b": ["a"], "c": ["a"]}) == [["a", "b"], ["c"]]
    assert blocked(["a", "b", "c", "d"], [("b", "a"), ("c", "b")], ["a"]) == {"b": ["a"], "c": ["b"]}


@pytest.fixture
def store(spark):
    found = LocalStore(spark, workspace(spark, "tables"))
    found.create_schema("c", "s")
    return found


def test_real_runs_keep_rows(spark, store):
    engine = Engine(spark, store, store)
    parent = make("parent", ID, NAME, primary_key=["id"], properties=WIDE)
    child = make("child", Column("k", Integer(), False), Column("pid", Integer()), foreign_keys=[ForeignKey("pid", parent)], properties=WIDE, clustered_by=["pid"])
    report = engine.sync(child, parent)
    assert [t.name for t in report.tables] == ["c.s.parent", "c.s.child"] and report.counts == {"changed": 2, "unchanged": 0, "failed": 0}
    store.append("c.s.parent", spark.createDataFrame([(1, "Ada")], "id int, name string"))
    with pytest.raises(Exception, match="required"):
        store.append("c.s.parent", spark.createDataFrame([(None, "x")], "id int, name string"))
    assert not engine.sync(child, parent).has_changes
    second = make("parent", ID, Column("title", String(), renamed_from="name"), Column("age", Integer()), primary_key=["id"], properties=WIDE, comment="people")
    engine.sync(second)
    store.append("c.s.parent", spark.createDataFrame([(2, "Bob", 7)], "id int, title string, age int"))
    engine.sync(make("parent", ID, Column("title", String()), Column("age", Long()), primary_key=["id"], properties=WIDE, comment="people"))
    assert sorted(map(tuple, store.load("c.s.parent").collect())) == [(1, "Ada", None), (2, "Bob", 7)]
    assert dict(store.load("c.s.parent").dtypes)["age"] == "bigint"
    with pytest.raises(SyncFailed) as e:
        engine.sync(make("parent", ID, Column("title", String()), Column("age", Long()), properties=WIDE, comment="people"))
    assert [f.extra["rule"] for f in e.value.report.tables[0].failures] == ["PrimaryKeyReferencedByForeignKeys"]
    with pytest.raises(Conflict):
        store._commit("c.s.parent", {"version": 1})


class Fixed:
    def __init__(self, states=None, fail=""):
        self.states, self.fail, self.ran = states or {}, fail, []

    def read(self, table_ids):
        return {t: self.states.get(t) for t in table_ids}

    def execute(self, table, action):
        if self.fail and self.fail in action["statement"]:
            raise RuntimeError("refused\n" * 9)
        self.ran.append(action["statement"])


def test_failures_block_dependents_only(spark):
    a = make("a", ID, primary_key=["id"], tags={"x": "1"})
    b = make("b", ID, Column("aid", Integer()), primary_key=["id"], foreign_keys=[ForeignKey("aid", a)])
    c = make("c", ID, Column("bid", Integer()), foreign_keys=[ForeignKey("bid", b)])
    z = make("z", ID)
    backend = Fixed(fail="SET TAGS")
    with pytest.raises(SyncFailed) as e:
        Engine(spark, backend, backend).sync(z, c, b, a)
    report = e.value.report
    status = {t.name[4:]: (t.status, t.applied) for t in report.tables}
    assert status == {"a": ("EXECUTION_FAILED", 1), "b": ("FOREIGN_KEY_FAILED", None), "c": ("FOREIGN_KEY_FAILED", None), "z": ("SUCCESS", 1)}
    wire = {t["name"]: t for t in report.to_dict()["tables"]}
    failure = wire["c.s.a"]["failures"][0]
    assert (failure["phase"], failure["type"], failure["statement_index"], failure["exception_type"]) == ("EXECUTION", "ExecutionFailure", 1, "RuntimeError")
    assert len(failure["message"].split("\n")) == 5 and wire["c.s.a"]["execution"] == {"applied": 1, "total": 2}
    assert wire["c.s.b"]["failures"][0]["reason"] == "BLOCKED_BY_FAILED_DEPENDENCY" and wire["c.s.b"]["planned_sql_statements"]
    assert "partially applied 1/2" in report.render_diff() and "EXECUTION_FAILED" in report.render()
    dry = Engine(spark, Fixed({"c.s.a": ReadError("Oops", "no")})).sync(a, b, z, dry_run=True)
    assert {t.name[4:]: t.status for t in dry.tables} == {"a": "READ_FAILED", "b": "FOREIGN_KEY_FAILED", "z": "SUCCESS"}
    assert dry.to_dict()["schema_version"] == 2 and "PLAN — no planned SQL executed" in dry.render()
    with pytest.raises(DuplicateTable):
        Engine(spark, backend).sync(a, a)
    assert Engine(spark, backend).sync().tables == []


def test_unregistered_parent_and_cycle(spark):
    lost = make("lost", ID, primary_key=["id"])
    kid = make("kid", ID, Column("l", Integer()), foreign_keys=[ForeignKey("l", lost)])
    x0 = make("x", ID, Column("y", Integer()), primary_key=["id"])
    y = make("y", ID, Column("x", Integer()), primary_key=["id"], foreign_keys=[ForeignKey("x", x0)])
    x = make("x", ID, Column("y", Integer()), primary_key=["id"], foreign_keys=[ForeignKey("y", y)])
    report = Engine(spark, Fixed()).sync(kid, x, y, dry_run=True)
    assert {t.name[4:]: [f.extra["reason"] for f in t.failures] for t in report.tables} == {"kid": ["UNRESOLVABLE_REFERENCE"], "x": ["CYCLE"], "y": ["CYCLE"]}
    assert all(t.statements for t in report.tables)


DOC = '{"type": "MANAGED", "provider": "delta", "columns": [{"name": "id", "type": {"name": "int"}, "nullable": false}, {"name": "t", "type": {"name": "array", "element_type": {"name": "timestamp_ntz"}}}], "table_properties": {"delta.feature.x": "supported"}, "partition_columns": ["id"]}'


def test_descriptions():
    found = parse_description(DOC, "c.s.t")
    assert [(c.name, c.nullable, c.comment) for c in found.columns] == [("id", False, ""), ("t", True, "")] and found.partitioned_by == ("id",)
    for bad in ("", "[]", "{}", DOC.replace("MANAGED", "VIEW"), DOC.replace('"delta"', '"csv"'), DOC.replace('"int"', '"interval"'), DOC.replace('["id"]', '"id"'), DOC.replace('"supported"', "1"), DOC.replace("false", '"no"')):
        with pytest.raises(MetadataError):
            parse_description(bad, "c.s.t")


def test_session_catalog(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS spark_catalog.wright")
    spark.sql("DROP TABLE IF EXISTS spark_catalog.wright.seen")
    spark.sql("CREATE TABLE spark_catalog.wright.seen (id INT COMMENT 'key', d DECIMAL(5,1)) USING parquet COMMENT 'seen'")
    catalog = SparkCatalog(spark, providers=("parquet",))
    found = catalog.read(["spark_catalog.wright.seen", "spark_catalog.wright.gone", "spark_catalog.nowhere.t"])
    state = found["spark_catalog.wright.seen"]
    assert [(c.name, kinds.render(c.type), c.comment) for c in state.columns] == [("id", "INT", "key"), ("d", "DECIMAL(5,1)", "")] and state.comment == "seen"
    assert found["spark_catalog.wright.gone"] is None and isinstance(found["spark_catalog.nowhere.t"], ReadError)
    table = Table("spark_catalog", "wright", "seen", [Column("id", Integer(), comment="${env:HOME}"), Column("d", Decimal(5, 1)), Column("n", Date())], comment="seen")
    Engine(spark, catalog, catalog).sync(table)
    assert not Engine(spark, catalog, catalog).sync(table).has_changes
    assert run_statement(spark, "SELECT '${env:HOME}' AS x").first().x == "${env:HOME}"
    assert condition(Exception("[SOME_ERROR] text")) == "SOME_ERROR"
    spark.sql("DROP TABLE spark_catalog.wright.seen")


def test_rules_can_be_added_and_suppressed(spark):
    def no_strings(diff, d, o):
        found = diff.where((F.col("action") == "AddColumn") & (F.col("type_sql") == "STRING"))
        return found.select("table_id", "stream", "pos", F.lit("NoStrings").alias("rule"), F.lit("no strings").alias("message"), F.col("col").alias("subject"))

    table, state = make("t", ID, Column("b", String()), Column("c", Integer(), False)), seen("t", ID)
    report = Engine(spark, Fixed({"c.s.t": state}), suppress=["NonNullableColumnAdd"], extra_rules=[no_strings]).sync(table, dry_run=True)
    assert [(f.extra["rule"], f.extra["subject"]) for f in report.tables[0].failures] == [("NoStrings", "b")]
