import pytest
from pyspark.sql import types as T

from tablewright.functions import types as kinds
from tablewright.operators.declare import SELF, Column, ForeignKey, Table, may_change
from tablewright.schema import Array, Binary, Boolean, Date, Decimal, Integer, Long, Map, String, Struct, StructField, Timestamp, TimestampNtz, Variant

ID = Column("id", Integer(), False)
MAPPED = {"delta.columnMapping.mode": "name"}


def table(*columns, name="t", **options):
    return Table("c", "s", name, columns or (ID,), **options)


@pytest.mark.parametrize("kind, sql, shown", [
    (Integer(), "INT", "Integer"), (Decimal(10, 2), "DECIMAL(10,2)", "Decimal(10,2)"), (Array(Long()), "ARRAY<BIGINT>", "Array<Long>"),
    (Map(String(), Date()), "MAP<STRING,DATE>", "Map<String, Date>"), (TimestampNtz(), "TIMESTAMP_NTZ", "TimestampNtz"),
    (Struct([StructField("a", Long(), False), StructField("b`c", Variant())]), "STRUCT<`a`: BIGINT NOT NULL, `b``c`: VARIANT>", "Struct<a: Long NOT NULL, b`c: Variant>"),
])
def test_type_texts(kind, sql, shown):
    assert kinds.render(kind) == sql and kinds.display(kind) == shown
    assert kinds.canonical(kinds.from_document(kinds.to_document(kind))) == kinds.canonical(kind)


def test_type_identity():
    a = Struct([StructField("A", Integer(), False)])
    b = Struct([StructField("a", Integer(), False)])
    c = Struct([StructField("a", Integer(), True)])
    assert kinds.canonical(a) == kinds.canonical(b) != kinds.canonical(c)
    assert kinds.canonical(Array(Integer(), True)) == kinds.canonical(Array(Integer(), False))


@pytest.mark.parametrize("doc", [
    None, "int", {}, {"name": "interval"}, {"name": "decimal"}, {"name": "decimal", "precision": "10", "scale": 2}, {"name": "decimal", "precision": 39, "scale": 0},
    {"name": "string", "collation": "UNICODE"}, {"name": "struct", "fields": []}, {"name": "struct", "fields": [{"name": " ", "type": {"name": "int"}}]},
    {"name": "map", "key_type": {"name": "map", "key_type": {"name": "int"}, "value_type": {"name": "int"}}, "value_type": {"name": "int"}},
])
def test_unmappable(doc):
    assert kinds.from_document(doc) is None


def test_deep_nesting_is_unmappable():
    doc = {"name": "int"}
    for _ in range(100_000):
        doc = {"name": "array", "element_type": doc}
    assert kinds.from_document(doc) is None


def test_aliases():
    assert isinstance(kinds.from_document({"name": "varchar", "length": 3}), T.StringType)
    assert isinstance(kinds.from_document({"name": "timestamp_ltz"}), Timestamp)


@pytest.mark.parametrize("build", [
    lambda: Column("", Integer()), lambda: Column("a", Integer(), renamed_from="A"), lambda: Column("a", Integer(), tags={" ": "x"}),
    lambda: Column("a", Integer(), tags={str(i): "" for i in range(51)}), lambda: Column("a", Integer(), tags={"k": "v" * 257}),
    lambda: table(ID, Column("ID", Long())), lambda: table(partitioned_by=["nope"]), lambda: table(ID, Column("p", String()), partitioned_by=["P"]),
    lambda: table(partitioned_by=["id"]), lambda: table(ID, Column("p", String()), partitioned_by=["p"], clustered_by=["p"]),
    lambda: table(*[Column(f"c{i}", Integer()) for i in range(6)], clustered_by=[f"c{i}" for i in range(5)]), lambda: table(ID, Column("b", Boolean()), clustered_by=["b"]),
    lambda: table(ID, Column("b", Array(Integer())), partitioned_by=["b"]), lambda: table(properties={"other": "1"}), lambda: table(properties={"delta.enableChangeDataFeed": "TRUE"}),
    lambda: table(properties={"delta.dataSkippingNumIndexedCols": "-2"}), lambda: table(properties={"delta.logRetentionDuration": "interval 1 day 2 hours"}),
    lambda: table(ID, Column("a b", Integer())), lambda: table(ID, Column("s", Struct([StructField("x=", Integer())]))), lambda: table(Column("_commit_version", Long()), properties={"delta.enableChangeDataFeed": "true"}),
    lambda: table(ID, Column("b", Integer(), renamed_from="a")), lambda: table(ID, Column("a", Integer()), Column("b", Integer(), renamed_from="a"), properties=MAPPED),
    lambda: table(ID, Column("b", Integer(), renamed_from="a"), properties=MAPPED, scope="metadata"), lambda: table(Column("a", Integer()), primary_key=["a"]), lambda: table(primary_key=[]),
    lambda: table(primary_key_name="x"), lambda: table(primary_key=["id"], primary_key_name=" "), lambda: table(scope="all"), lambda: Table("c", "s", "a.b", [ID]), lambda: Table("c" * 256, "s", "t", [ID]),
    lambda: table(ID, Column("s", Struct([StructField("x", Integer(), False)]))), lambda: table(ID, Column("s", Array(Struct([StructField("x", Integer(), False)])), False)),
    lambda: table(foreign_keys=[ForeignKey("id", table())]), lambda: table(Column("p", Long()), foreign_keys=[ForeignKey("p", table(primary_key=["id"]))]),
    lambda: table(ID, foreign_keys=[ForeignKey("x", table(primary_key=["id"]))]), lambda: table(ID, foreign_keys=[ForeignKey("id", Table("other", "s", "t", [ID], primary_key=["id"]))]),
])
def test_refused(build):
    with pytest.raises(ValueError):
        build()


@pytest.mark.parametrize("build", [lambda: Column("a", "int"), lambda: table(partitioned_by="id"), lambda: table(primary_key="id"), lambda: table(foreign_keys=[ForeignKey("id", "t")]), lambda: Column("a", Decimal(10, True))])
def test_wrong_kinds(build):
    with pytest.raises(TypeError):
        build()


def test_names_and_keys():
    parent = table(Column("Tenant", Integer(), False), Column("Account", Integer(), False), primary_key=["Tenant", "Account"], name="Parent")
    child = table(Column("account", Integer()), Column("tenant", Integer()), ID, foreign_keys=[ForeignKey(["tenant", "account"], parent)])
    (key,) = child.foreign_keys
    assert parent.table_id == "c.s.parent" and (key.columns, key.parent_columns) == (("account", "tenant"), ("Account", "Tenant"))
    mapped = table(Column("a", Integer()), Column("b", Integer()), foreign_keys=[ForeignKey({"b": "tenant", "a": "ACCOUNT"}, parent)])
    assert mapped.foreign_keys[0].parent_columns == ("Account", "Tenant")
    own = table(ID, Column("up", Integer()), primary_key=["id"], foreign_keys=[ForeignKey("up", SELF)])
    assert own.foreign_keys[0].parent == own.table_id
    with pytest.raises(ValueError):
        table(Column("a", Integer()), Column("b", Integer()), foreign_keys=[ForeignKey(["a", "b"], parent)])
    with pytest.raises(ValueError):
        table(Column("p", Integer()), foreign_keys=[ForeignKey("p", own), ForeignKey("p", own)])


def test_narrow_scopes_skip_structural_checks():
    assert table(ID, Column("a b", Integer()), scope="annotations").manages("COLUMN_TAGS")
    assert not table(scope="annotations").manages("PRIMARY_KEY") and table(scope="metadata").manages("FOREIGN_KEYS")


def test_transitions():
    mode = "delta.columnMapping.mode"
    assert may_change(mode, None, "name") and may_change(mode, "none", "name") and may_change(mode, "name", "name")
    assert not may_change(mode, "name", "none") and not may_change(mode, "name", None) and may_change("delta.enableChangeDataFeed", "true", None)


def test_spark_schema():
    schema = table(ID, Column("b", Binary(), comment="x")).spark_schema()
    assert schema == T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("b", T.BinaryType())])
