"""Registered queries over the engine's relations, and the SQL that should give the same rows.

Declared and observed states are constants; the SQL gets the same state as VALUES and
derives the answer by itself. Queries over rows run on the tables of the folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import estate_queries as estate
from .functions import types as kinds
from .operators.declare import SCOPES, BoundKey, Column, ForeignKey, Table
from .operators.differ import PHASES, differences
from .operators.engine import Engine
from .operators.policy import failures, foreign_key_verdicts, widening
from .operators.relations import SCHEMAS, Observed, ObservedColumn, _rows, relations
from .plans.graph import blocked, dependency_order
from .plans.statements import create_statements, plan
from .schema import Date, Double, Integer, Long, String, TimestampNtz
from .sources import information_schema as info
from .sources.files import observed_parquet, workspace
from .sources.local_store import LocalStore

MAPPED = {"delta.columnMapping.mode": "name"}
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The star schema as it should be. Keys need required columns, which files cannot record: the observed side is seeded.
REGION = Table("lake", "sales", "region", [Column("r_regionkey", Integer(), False), Column("r_name", String(), comment="region's name", tags={"tier": "gold"})],
               primary_key=["r_regionkey"], comment="regions", tags={"owner": "core"}, properties=MAPPED)
NATION = Table("lake", "sales", "nation", [Column("n_nationkey", Integer(), False), Column("n_title", String(), renamed_from="n_name"), Column("n_regionkey", Integer())],
               primary_key=["n_nationkey"], foreign_keys=[ForeignKey("n_regionkey", REGION)], properties=MAPPED | {"delta.enableChangeDataFeed": "true"})
CUSTOMER = Table("lake", "sales", "customer", [
    Column("c_custkey", Long(), False), Column("c_name", String()), Column("c_nationkey", Integer()), Column("c_acctbal", Double()),
    Column("c_mktsegment", String(), comment="segment"), Column("c_since", Date(), comment="first order")],
    primary_key=["c_custkey"], foreign_keys=[ForeignKey("c_nationkey", NATION, name="customer_nation")], clustered_by=["c_nationkey"])
ORDERS = Table("lake", "sales", "orders", [
    Column("o_orderkey", Long(), False), Column("o_custkey", Long()), Column("o_orderstatus", String()), Column("o_totalprice", Double()),
    Column("o_orderdate", TimestampNtz()), Column("o_clerk", String())], primary_key=["o_orderkey"], foreign_keys=[ForeignKey("o_custkey", CUSTOMER)], properties=MAPPED)
LINEITEM = Table("lake", "sales", "lineitem", [
    Column("l_orderkey", Long()), Column("l_partkey", Long()), Column("L_SUPPKEY", Long()), Column("l_linenumber", Long()), Column("l_shipdate", TimestampNtz())],
    foreign_keys=[ForeignKey("l_orderkey", ORDERS)], properties={"delta.enableTypeWidening": "true"})
DESIRED = (REGION, NATION, CUSTOMER, ORDERS, LINEITEM)

SEEDS: dict[str, dict] = {
    "region": {"required": ("r_regionkey",), "primary_key": ("region_pk", ["r_regionkey"]), "tags": {"owner": "ops", "old": "x"}, "column_tags": {"r_name": {"tier": "silver"}},
               "properties": MAPPED, "inbound": [("nation_region", "lake.sales.nation")]},
    "nation": {"required": ("n_nationkey",), "primary_key": ("nation_pk", ["N_NATIONKEY"]), "properties": MAPPED | {"delta.enableChangeDataFeed": "false"},
               "foreign_keys": [BoundKey(("n_regionkey",), "lake.sales.region", ("r_regionkey",), "nation_region")]},
    "customer": {"required": ("c_custkey",), "clustered_by": ["c_name"], "comments": {"c_name": "full name"},
                 "foreign_keys": [BoundKey(("c_nationkey",), "lake.sales.region", ("r_regionkey",), "old_fk")]},
    "lineitem": {"properties": {"delta.enableTypeWidening": "true", "delta.logRetentionDuration": "interval 7 days"}},
}


def _observed(spark: SparkSession, sf_dir: str) -> list[Observed]:
    """The catalog: orders does not exist yet."""
    return [observed_parquet(spark, f"{sf_dir}/{t}.parquet", f"lake.sales.{t}", **SEEDS[t]) for t in SEEDS]


def _star(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    return relations(spark, DESIRED), relations(spark, _observed(spark, sf_dir))


# state as SQL

def _value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_value, x)) + "]::VARCHAR[]"
    return "'" + str(x).replace("'", "''") + "'"


_SQL_TYPES = {"string": "VARCHAR", "int64": "BIGINT", "bool": "BOOLEAN"}


def values(columns: dict[str, str], rows: list[tuple]) -> str:
    """A SELECT of constant rows with typed columns."""
    names = ", ".join(columns)
    body = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) or "(" + ", ".join(["NULL"] * len(columns)) + ")"
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in columns.items())
    return f"SELECT {casts} FROM (VALUES {body}) AS v({names})" + ("" if rows else " WHERE false")


def _relation_sql(side: str, tables, *names: str) -> str:
    """CTEs with the relations of constant tables."""
    out = []
    for name in names:
        columns = {c: _SQL_TYPES.get(str(t), "VARCHAR[]") for c, t in SCHEMAS[name].items()}
        rows = [tuple(r[c] for c in columns) for t in tables for r in _rows(t)[name]]
        out.append(f"{side}_{name} AS ({values(columns, rows)})")
    return ", ".join(out)


def _seeded() -> list[Observed]:
    """The observed side without its columns' types, which only files know."""
    out = []
    for t, seed in SEEDS.items():
        seed = {k: v for k, v in seed.items() if k not in ("required", "comments")}
        out.append(Observed(f"lake.sales.{t}", [ObservedColumn("x", T.IntegerType())], **seed))
    return out


_DUCK = {"BIGINT": "BIGINT", "INTEGER": "INT", "VARCHAR": "STRING", "DOUBLE": "DOUBLE", "FLOAT": "FLOAT", "TIMESTAMP": "TIMESTAMP_NTZ", "FLOAT[]": "ARRAY<FLOAT>"}
_TYPE = "CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _DUCK.items()) + " END"


def _described(tables) -> str:
    """Column names and types as DuckDB sees them; the order of DESCRIBE is kept out of it."""
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, {_TYPE} AS type_sql FROM (DESCRIBE {t})" for t in tables)


# queries

def observed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = relations(spark, [observed_parquet(spark, f"{sf_dir}/{t}.parquet", f"lake.sales.{t}") for t in STAR])
    return o["columns"].select(F.element_at(F.split("table_id", r"\."), 3).alias("table_name"), F.col("name").alias("column_name"), "type_sql")


def _of(*actions: str):
    return F.col("action").isin(*actions)


def diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = differences(*_star(spark, sf_dir))
    return diff.where(_of("AddColumn", "DropColumn", "AlterColumnType", "RenameColumn", "ColumnCaseDrift")).select("table_id", "action", "subject", "type_sql")


def _diff_columns_sql() -> str:
    return f"""
WITH {_relation_sql("d", DESIRED, "columns")}, o AS (
  SELECT 'lake.sales.' || table_name AS table_id, column_name AS name, lower(column_name) AS k, type_sql FROM ({_described(SEEDS)})
), d AS (SELECT * FROM d_columns WHERE table_id IN (SELECT table_id FROM o)
), hints AS (
  SELECT d.table_id, s.name AS src, s.k AS src_k, d.name AS new, d.k AS new_k FROM d JOIN o s ON s.table_id = d.table_id AND s.k = lower(d.renamed_from)
  WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.table_id = d.table_id AND x.k = d.k)
), p AS (
  SELECT o.table_id, coalesce(h.new, o.name) AS name, coalesce(h.new_k, o.k) AS k, o.type_sql FROM o LEFT JOIN hints h ON h.table_id = o.table_id AND h.src_k = o.k
), j AS (
  SELECT coalesce(d.table_id, p.table_id) AS table_id, d.name AS dn, p.name AS pn, d.type_sql AS dt, p.type_sql AS pt FROM d FULL JOIN p ON d.table_id = p.table_id AND d.k = p.k
)
SELECT table_id, 'AddColumn' AS action, dn AS subject, dt AS type_sql FROM j WHERE pn IS NULL
UNION ALL SELECT table_id, 'DropColumn', pn, NULL FROM j WHERE dn IS NULL
UNION ALL SELECT table_id, 'AlterColumnType', pn, dt FROM j WHERE dn IS NOT NULL AND pn IS NOT NULL AND dt <> pt
UNION ALL SELECT table_id, 'ColumnCaseDrift', dn, NULL FROM j WHERE lower(dn) = lower(pn) AND dn <> pn
UNION ALL SELECT table_id, 'RenameColumn', src, NULL FROM hints
"""


def diff_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = differences(*_star(spark, sf_dir))
    return diff.where(_of("SetTableTag", "UnsetTableTag", "SetColumnTag", "UnsetColumnTag")).select("table_id", "action", "subject", "value", "old")


_DIFF_TAGS = """
, j AS (
  SELECT coalesce(d.table_id, o.table_id) AS table_id, coalesce(d.k, o.k) AS k, coalesce(d.tag, o.tag) AS tag, d.value, o.value AS old
  FROM d_tags d FULL JOIN o_tags o ON d.table_id = o.table_id AND d.tag = o.tag AND d.k IS NOT DISTINCT FROM o.k
)
SELECT table_id, (CASE WHEN value IS NULL THEN 'Unset' ELSE 'Set' END) || (CASE WHEN k IS NULL THEN 'Table' ELSE 'Column' END) || 'Tag' AS action,
  CASE WHEN k IS NULL THEN tag ELSE k || '.' || tag END AS subject, value, old
FROM j WHERE value IS DISTINCT FROM old
"""


def diff_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = differences(*_star(spark, sf_dir))
    return diff.where(_of("SetProperty", "UnsetProperty", "PropertyUndeclared")).select("table_id", "action", "key", "value", "old")


_DIFF_PROPERTIES = """
, d AS (SELECT *, true AS declared FROM d_properties WHERE table_id IN (SELECT table_id FROM o_tables)), j AS (
  SELECT coalesce(d.table_id, o.table_id) AS table_id, coalesce(d.key, o.key) AS key, d.value, o.value AS old, coalesce(declared, false) AS declared
  FROM d FULL JOIN o_properties o ON d.table_id = o.table_id AND d.key = o.key
)
SELECT table_id, CASE WHEN NOT declared THEN 'PropertyUndeclared' WHEN value IS NULL THEN 'UnsetProperty' ELSE 'SetProperty' END AS action, key, value, old
FROM j WHERE value IS DISTINCT FROM old
"""


def diff_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = differences(*_star(spark, sf_dir))
    return diff.where(_of("SetPrimaryKey", "DropPrimaryKey", "SetForeignKey", "DropForeignKey")).select("table_id", "action", "subject", "parent")


_DIFF_KEYS = """
, present AS (SELECT table_id FROM o_tables), pk AS (
  SELECT coalesce(d.table_id, o.table_id) AS table_id, d.key AS dk, o.key AS ok, d.name AS dn, o.name AS n, d.columns
  FROM (SELECT * FROM d_primary_keys WHERE table_id IN (FROM present)) d FULL JOIN o_primary_keys o ON d.table_id = o.table_id
), fk AS (
  SELECT coalesce(d.table_id, o.table_id) AS table_id, d.ord AS d_ord, o.ord AS o_ord, d.name AS dn, o.name AS n, d.columns, d.parent AS dp, o.parent AS op
  FROM d_foreign_keys d FULL JOIN o_foreign_keys o ON d.table_id = o.table_id AND d.key = o.key
)
SELECT table_id, 'DropPrimaryKey' AS action, n AS subject, NULL AS parent FROM pk WHERE ok IS NOT NULL AND ok IS DISTINCT FROM dk
UNION ALL SELECT table_id, 'SetPrimaryKey', coalesce(dn, array_to_string(columns, ', ')), NULL FROM pk WHERE dk IS NOT NULL AND ok IS DISTINCT FROM dk
UNION ALL SELECT table_id, 'DropForeignKey', n, op FROM fk WHERE d_ord IS NULL
UNION ALL SELECT table_id, 'SetForeignKey', coalesce(dn, array_to_string(columns, ', ')), dp FROM fk WHERE o_ord IS NULL
"""


def diff_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = differences(*_star(spark, sf_dir))
    return diff.where(_of("AlterClustering", "PartitioningChanged")).select("table_id", "action", F.array_join("cols", ",").alias("new_layout"), F.array_join("old_cols", ",").alias("old_layout"))


_DIFF_LAYOUT = """
, l AS (
  SELECT t.table_id, kinds.kind, coalesce((SELECT string_agg(name, ',' ORDER BY pos) FROM d_layout d WHERE d.table_id = t.table_id AND d.kind = kinds.kind), '') AS new_layout,
    coalesce((SELECT string_agg(name, ',' ORDER BY pos) FROM o_layout o WHERE o.table_id = t.table_id AND o.kind = kinds.kind), '') AS old_layout
  FROM o_tables t, (VALUES ('cluster'), ('partition')) AS kinds(kind)
)
SELECT table_id, CASE kind WHEN 'cluster' THEN 'AlterClustering' ELSE 'PartitioningChanged' END AS action, new_layout, old_layout FROM l
WHERE CASE kind WHEN 'cluster' THEN list_sort(string_split(lower(new_layout), ',')) <> list_sort(string_split(lower(old_layout), ',')) ELSE lower(new_layout) <> lower(old_layout) END
"""


def required_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = [observed_parquet(spark, f"{sf_dir}/{t}.parquet", f"lake.sales.{t}") for t in STAR]
    same = [Table("lake", "sales", o.table_id.split(".")[2], [Column(c.name, c.type) for c in o.columns]) for o in observed]
    diff = differences(relations(spark, same), relations(spark, observed))
    return diff.where(_of("EnableTableFeature")).select("table_id", F.col("key").alias("feature"))


def policy_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, o = _star(spark, sf_dir)
    return failures(differences(d, o), d, o).select("table_id", "rule", "subject")


def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, o = _star(spark, sf_dir)
    return plan(differences(d, o), d, o).select("table_id", "stmt_ord", "action", "subject")


def plan_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = relations(spark, DESIRED)
    return create_statements(d)


def _creates_sql() -> str:
    q = lambda x: f"'`' || replace({x}, '`', '``') || '`'"
    lit = lambda x: "'''' || replace(replace(" + x + ", '\\', '\\\\'), '''', '''''') || ''''"
    return f"""
WITH {_relation_sql("d", DESIRED, "tables", "columns", "primary_keys", "properties", "layout")}, c AS (
  SELECT table_id, string_agg({q("name")} || ' ' || type_sql || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END || CASE WHEN comment = '' THEN '' ELSE ' COMMENT ' || {lit("comment")} END, ', ' ORDER BY ord) AS x
  FROM d_columns GROUP BY table_id
), k AS (
  SELECT table_id, ', ' || CASE WHEN name IS NULL THEN '' ELSE 'CONSTRAINT ' || {q("name")} || ' ' END || 'PRIMARY KEY (`' || array_to_string(columns, '`, `') || '`)' AS x FROM d_primary_keys
), p AS (
  SELECT table_id, ' TBLPROPERTIES (' || string_agg({lit("key")} || '=' || {lit("value")}, ', ' ORDER BY key) || ')' AS x FROM d_properties WHERE value IS NOT NULL GROUP BY table_id
), l AS (
  SELECT table_id, CASE kind WHEN 'partition' THEN ' PARTITIONED BY (' ELSE ' CLUSTER BY (' END || string_agg({q("name")}, ', ' ORDER BY pos) || ')' AS x FROM d_layout GROUP BY table_id, kind
)
SELECT t.table_id, 'CREATE TABLE `' || replace(t.table_id, '.', '`.`') || '` (' || c.x || coalesce(k.x, '') || ') USING delta'
  || CASE WHEN t.comment = '' THEN '' ELSE ' COMMENT ' || {lit("t.comment")} END || coalesce(p.x, '') || coalesce(l.x, '') AS create_sql
FROM d_tables t JOIN c USING (table_id) LEFT JOIN k USING (table_id) LEFT JOIN p USING (table_id) LEFT JOIN l USING (table_id)
"""


_ALL_TYPES = ["TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "BOOLEAN", "STRING", "BINARY", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "VARIANT",
              "DECIMAL(10,0)", "DECIMAL(10,2)", "DECIMAL(12,2)", "DECIMAL(12,3)", "DECIMAL(20,0)", "ARRAY<INT>"]


def widening_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(a, b) for a in _ALL_TYPES for b in _ALL_TYPES if a != b]
    df = spark.createDataFrame(pairs, "old_type string, new_type string")
    return df.where(widening(F.col("old_type"), F.col("new_type")))


_WIDENING = f"""
WITH t AS (SELECT unnest({_value(_ALL_TYPES)}) AS t), p AS (
  SELECT a.t AS old_type, b.t AS new_type, TRY_CAST(regexp_extract(a.t, '\\((\\d+),', 1) AS INT) AS p, TRY_CAST(regexp_extract(a.t, ',(\\d+)\\)', 1) AS INT) AS s,
    TRY_CAST(regexp_extract(b.t, '\\((\\d+),', 1) AS INT) AS q, TRY_CAST(regexp_extract(b.t, ',(\\d+)\\)', 1) AS INT) AS r
  FROM t a JOIN t b ON a.t <> b.t
)
SELECT old_type, new_type FROM p WHERE CASE
  WHEN old_type = 'TINYINT' AND new_type IN ('SMALLINT', 'INT', 'BIGINT', 'DOUBLE') THEN true
  WHEN old_type = 'SMALLINT' AND new_type IN ('INT', 'BIGINT', 'DOUBLE') THEN true
  WHEN old_type = 'INT' AND new_type IN ('BIGINT', 'DOUBLE') THEN true
  WHEN old_type = 'FLOAT' THEN new_type = 'DOUBLE' WHEN old_type = 'DATE' THEN new_type = 'TIMESTAMP_NTZ'
  WHEN old_type IN ('TINYINT', 'SMALLINT', 'INT') AND q IS NOT NULL THEN q - r >= 10 WHEN old_type = 'BIGINT' AND q IS NOT NULL THEN q - r >= 20
  WHEN p IS NOT NULL AND q IS NOT NULL THEN r >= s AND q - r >= p - s ELSE false END
"""

# information_schema rows: catalog, schema and constraint, as the scans join them
_TC = {"constraint_catalog": "VARCHAR", "constraint_schema": "VARCHAR", "constraint_name": "VARCHAR", "table_catalog": "VARCHAR", "table_schema": "VARCHAR", "table_name": "VARCHAR", "constraint_type": "VARCHAR"}
_TC_ROWS = [("lake", "sales", n, "lake", "sales", t, k) for n, t, k in (
    ("acct_pk", "account", "PRIMARY KEY"), ("acct_uq", "account", "UNIQUE"), ("pay_pk", "payment", "PRIMARY KEY"), ("pay_acct", "payment", "FOREIGN KEY"),
    ("ref_acct", "refund", "FOREIGN KEY"), ("aud_uq", "audit", "FOREIGN KEY"))]
_KCU = {"constraint_catalog": "VARCHAR", "constraint_schema": "VARCHAR", "constraint_name": "VARCHAR", "table_catalog": "VARCHAR", "table_schema": "VARCHAR", "table_name": "VARCHAR",
        "column_name": "VARCHAR", "ordinal_position": "BIGINT", "position_in_unique_constraint": "BIGINT"}
_KCU_ROWS = [("lake", "sales", n, "lake", "sales", t, c, i, u) for n, t, c, i, u in (
    ("acct_pk", "account", "tenant_id", 1, None), ("acct_pk", "account", "account_id", 2, None), ("acct_uq", "account", "email", 1, None), ("pay_pk", "payment", "id", 1, None),
    ("pay_acct", "payment", "acct", 1, 2), ("pay_acct", "payment", "tenant", 2, 1), ("ref_acct", "refund", "tenant", 1, 1), ("ref_acct", "refund", "acct", 2, 2), ("aud_uq", "audit", "mail", 1, 1))]
_RC = {"constraint_catalog": "VARCHAR", "constraint_schema": "VARCHAR", "constraint_name": "VARCHAR", "unique_constraint_catalog": "VARCHAR", "unique_constraint_schema": "VARCHAR", "unique_constraint_name": "VARCHAR"}
_RC_ROWS = [("lake", "sales", a, "lake", "sales", b) for a, b in (("pay_acct", "acct_pk"), ("ref_acct", "acct_pk"), ("aud_uq", "acct_uq"))]
_INFO = f"WITH tc AS ({values(_TC, _TC_ROWS)}), kcu AS ({values(_KCU, _KCU_ROWS)}), rc AS ({values(_RC, _RC_ROWS)}) "


def _info(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    ddl = lambda c: ", ".join(f"{k} {'long' if t == 'BIGINT' else 'string'}" for k, t in c.items())
    return spark.createDataFrame(_TC_ROWS, ddl(_TC)), spark.createDataFrame(_KCU_ROWS, ddl(_KCU)), spark.createDataFrame(_RC_ROWS, ddl(_RC))


def info_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tc, kcu, _ = _info(spark)
    return info.primary_key(tc, kcu, "lake", "sales", "account")


def info_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tc, kcu, rc = _info(spark)
    return info.foreign_keys(rc, tc, kcu, "lake", "sales", "payment").select("constraint_name", "local_column", "referenced_table", "referenced_column", "ordinal_position")


def info_inbound_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tc, _, rc = _info(spark)
    return info.inbound_keys(rc, tc, "lake", "sales", "account")


# Foreign keys as a catalog of declarations might hold them: (child, parent, columns, parent columns)
def _graph() -> list[Table]:
    make = lambda name, *keys: Table("lake", "g", name, [Column("id", Integer(), False), *[Column(f"{p.name}_id", Integer()) for p in keys]], primary_key=["id"],
                                     foreign_keys=[ForeignKey(f"{p.name}_id", p) for p in keys])
    a = make("a")
    b, lost = make("b", a), make("lost")
    c, e = make("c", a, b), make("e", lost)
    other_a = Table("lake", "g", "wide", [Column("id", Long(), False)], primary_key=["id"])
    f = Table("lake", "g", "f", [Column("id", Integer(), False), Column("w", Long())], primary_key=["id"], foreign_keys=[ForeignKey("w", other_a)])
    registered = Table("lake", "g", "wide", [Column("id", Integer(), False)], primary_key=["id"])
    return [c, b, a, e, make("h", e), f, registered]


def fk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_key_verdicts(relations(spark, _graph())).select("table_id", "parent", "reason")


_FK_VERDICTS = """
SELECT fk.table_id, fk.parent, CASE WHEN t.table_id IS NULL THEN 'UNRESOLVABLE_REFERENCE'
  WHEN p.key IS NULL OR list_sort(list_transform(fk.parent_columns, lambda x: lower(x))) <> p.key THEN 'REFERENCED_COLUMNS_NOT_A_KEY'
  WHEN EXISTS (SELECT 1 FROM d_columns a, d_columns b WHERE a.table_id = fk.table_id AND b.table_id = fk.parent AND len(fk.columns) = 1 AND a.name = fk.columns[1] AND b.k = lower(fk.parent_columns[1]) AND a.type_sql <> b.type_sql)
  THEN 'REFERENCED_COLUMN_TYPE_MISMATCH' END AS reason
FROM d_foreign_keys fk LEFT JOIN d_tables t ON t.table_id = fk.parent LEFT JOIN d_primary_keys p ON p.table_id = fk.parent
"""


def blocked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that a failed table holds up, directly or through others."""
    tables = _graph()
    names = {t.table_id for t in tables}
    edges = [(t.table_id, k.parent) for t in tables for k in t.foreign_keys if k.parent in names]
    bad = [r["table_id"] for r in fk_verdicts(spark, sf_dir).where("reason IS NOT NULL").collect()]
    order, _ = dependency_order(names, edges)
    rows = [(t,) for t in blocked(order, edges, [*bad, "lake.g.a"])]
    return spark.createDataFrame(rows, "table_id string")


_BLOCKED = """
, bad AS (SELECT 'lake.g.a' AS t UNION SELECT 'lake.g.e' UNION SELECT 'lake.g.f'), reach(t) AS (
  SELECT t FROM bad UNION SELECT k.table_id FROM reach r JOIN d_foreign_keys k ON k.parent = r.t
)
SELECT DISTINCT t AS table_id FROM reach WHERE t NOT IN (SELECT t FROM bad)
"""


def dependency_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tables of the run must come before each table."""
    tables = _graph()
    names = {t.table_id for t in tables}
    edges = [(t.table_id, k.parent) for t in tables for k in t.foreign_keys if k.parent in names]
    depth: dict[str, int] = {}
    for t in dependency_order(names, edges)[0]:
        depth[t] = max((depth[p] + 1 for c, p in edges if c == t), default=0)
    return spark.createDataFrame(list(depth.items()), "table_id string, depth long")


_DEPTH = """
, walk(t, n) AS (SELECT table_id, CAST(0 AS BIGINT) FROM d_tables UNION ALL SELECT k.table_id, w.n + 1 FROM walk w JOIN d_foreign_keys k ON k.parent = w.t)
SELECT t AS table_id, max(n) AS depth FROM walk WHERE t IN (SELECT table_id FROM d_tables) GROUP BY t
"""


class _Fixed:
    """A reader of given states."""

    def __init__(self, states):
        self.states = {s.table_id: s for s in states}

    def read(self, table_ids):
        return {t: self.states.get(t) for t in table_ids}


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each table in a dry run."""
    report = Engine(spark, _Fixed(_observed(spark, sf_dir))).sync(*DESIRED, dry_run=True)
    return report.to_dataframe(spark).select("table_id", "status", "change_state")


def _evolve(spark: SparkSession, sf_dir: str, *versions: Table) -> DataFrame:
    """Rows of lineitem, stored under the first declaration, as read after syncing the others."""
    store = LocalStore(spark, workspace(spark, "store"))
    store.create_schema("lake", "sales")
    engine = Engine(spark, store, store)
    engine.sync(versions[0])
    table = versions[0].table_id
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    store.append(table, rows.select(*[c.name for c in versions[0].columns]))
    for v in versions[1:]:
        engine.sync(v)
    return store.load(table)


def _line(*columns: Column, **options) -> Table:
    return Table("lake", "sales", "line", columns, properties=MAPPED | {"delta.enableTypeWidening": "true"}, **options)


_KEY, _NUMBER, _PART = Column("l_orderkey", Long(), False), Column("l_linenumber", Integer()), Column("l_partkey", Long())


def rows_after_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolve(spark, sf_dir, _line(_KEY, _NUMBER), _line(_KEY, Column("line_no", Integer(), renamed_from="l_linenumber")))


def rows_after_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolve(spark, sf_dir, _line(_KEY, _NUMBER), _line(_KEY, _NUMBER, Column("note", String())))


def rows_after_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolve(spark, sf_dir, _line(_KEY, _NUMBER, _PART), _line(_KEY, _PART))


def rows_after_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolve(spark, sf_dir, _line(_KEY, _NUMBER), _line(_KEY, Column("l_linenumber", Long())))


def rows_after_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = _line(_KEY, Column("n", Integer(), renamed_from="l_linenumber"), Column("extra", String()))
    return _evolve(spark, sf_dir, _line(_KEY, _NUMBER, _PART), second, _line(_KEY, Column("n", Long()), Column("extra", String())))


def schema_conformed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read under a declaration's own schema: order, spelling and types as declared."""
    wanted = CUSTOMER.spark_schema()
    have = set(spark.read.parquet(f"{sf_dir}/customer.parquet").columns)
    return spark.read.schema(T.StructType([f for f in wanted.fields if f.name in have])).parquet(f"{sf_dir}/customer.parquet")


def planned_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: ordered statements that bring the star schema to its declared state, without tables whose changes are refused."""
    d, o = _star(spark, sf_dir)
    order, _ = dependency_order([t.table_id for t in DESIRED], [(t.table_id, k.parent) for t in DESIRED for k in t.foreign_keys])
    places = spark.createDataFrame(list(enumerate(order)), "table_ord int, table_id string")
    diff = differences(d, o)
    safe = plan(diff, d, o).join(failures(diff, d, o).select("table_id"), "table_id", "left_anti")
    return safe.join(F.broadcast(places), "table_id").select("table_ord", "table_id", "stmt_ord", "action", "statement").orderBy("table_ord", "stmt_ord")


# what the declarations above change besides columns, and the phase of every action
_OTHER_CHANGES = [
    ("region", "SetTableTag", "owner"), ("region", "UnsetTableTag", "old"), ("region", "SetColumnTag", "r_name.tier"), ("region", "SetColumnComment", "r_name"), ("region", "SetTableComment", ""),
    ("nation", "SetProperty", "delta.enableChangeDataFeed"), ("customer", "DropForeignKey", "old_fk"), ("customer", "AlterClustering", ""), ("customer", "SetColumnComment", "c_name"),
    ("customer", "SetColumnComment", "c_mktsegment"), ("customer", "SetPrimaryKey", "c_custkey"), ("customer", "SetForeignKey", "customer_nation"), ("orders", "CreateTable", ""), ("orders", "SetForeignKey", "o_custkey"),
    ("lineitem", "EnableTableFeature", "timestampNtz"), ("lineitem", "SetForeignKey", "l_orderkey"),
]
_IN_ORDER = ["CreateTable", "EnableTableFeature", "SetProperty", "UnsetProperty", "SetTableTag", "UnsetTableTag", "DropForeignKey", "DropPrimaryKey", "RenameColumn", "AddColumn", "AlterColumnType", "AlterClustering",
             "SetColumnTag", "UnsetColumnTag", "DropColumn", "SetColumnComment", "SetTableComment", "SetColumnNullability", "SetPrimaryKey", "SetForeignKey"]
_PLAN_ORDER = f"""
WITH facts(t, action, subject) AS (VALUES {", ".join(f"({_value(t)}, {_value(a)}, {_value(x)})" for t, a, x in _OTHER_CHANGES)}), phases(action, n) AS (VALUES {", ".join(f"('{a}', {i})" for i, a in enumerate(_IN_ORDER))}
), everything AS (
  SELECT 'lake.sales.' || t AS table_id, action, subject FROM facts UNION ALL SELECT table_id, action, subject FROM ({_diff_columns_sql()}) WHERE action <> 'ColumnCaseDrift'
)
SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY n, lower(subject), subject) AS INTEGER) AS stmt_ord, action, subject FROM everything JOIN phases USING (action)
"""
# the plan of the star schema: the text behind ALTER TABLE and the table's name, or the whole statement
_STAR_PLAN = [
    ("region", "SetTableTag", "SET TAGS ('owner'='core')"), ("region", "UnsetTableTag", "UNSET TAGS ('old')"), ("region", "SetColumnTag", "ALTER COLUMN `r_name` SET TAGS ('tier'='gold')"),
    ("region", "SetColumnComment", "ALTER COLUMN `r_name` COMMENT 'region''s name'"), ("region", "SetTableComment", "COMMENT ON TABLE `lake`.`sales`.`region` IS 'regions'"),
    ("nation", "SetProperty", "SET TBLPROPERTIES ('delta.enableChangeDataFeed'='true')"), ("nation", "RenameColumn", "RENAME COLUMN `n_name` TO `n_title`"),
    ("customer", "DropForeignKey", "DROP CONSTRAINT IF EXISTS `old_fk`"), ("customer", "AddColumn", "ADD COLUMN `c_since` DATE COMMENT 'first order'"), ("customer", "AlterClustering", "CLUSTER BY (`c_nationkey`)"),
    ("customer", "SetColumnComment", "ALTER COLUMN `c_mktsegment` COMMENT 'segment'"), ("customer", "SetColumnComment", "ALTER COLUMN `c_name` COMMENT ''"), ("customer", "SetPrimaryKey", "ADD PRIMARY KEY (`c_custkey`)"),
    ("customer", "SetForeignKey", "ADD CONSTRAINT `customer_nation` FOREIGN KEY (`c_nationkey`) REFERENCES `lake`.`sales`.`nation` (`n_nationkey`)"),
    ("orders", "CreateTable", "CREATE TABLE `lake`.`sales`.`orders` (`o_orderkey` BIGINT NOT NULL, `o_custkey` BIGINT, `o_orderstatus` STRING, `o_totalprice` DOUBLE, `o_orderdate` TIMESTAMP_NTZ, `o_clerk` STRING, "
     "PRIMARY KEY (`o_orderkey`)) USING delta TBLPROPERTIES ('delta.columnMapping.mode'='name')"),
    ("orders", "SetForeignKey", "ADD FOREIGN KEY (`o_custkey`) REFERENCES `lake`.`sales`.`customer` (`c_custkey`)"),
]
_PLANNED_STAR = f"""
WITH keys(child, parent) AS (VALUES ('nation', 'region'), ('customer', 'nation'), ('orders', 'customer'), ('lineitem', 'orders')), plan(n, t, action, tail) AS (VALUES
  {", ".join(f"({i}, {_value(t)}, {_value(a)}, {_value(x)})" for i, (t, a, x) in enumerate(_STAR_PLAN))}
), depth(t, d) AS (SELECT 'region', 0 UNION ALL SELECT child, d + 1 FROM depth JOIN keys ON parent = t)
SELECT CAST(d AS INTEGER) AS table_ord, 'lake.sales.' || t AS table_id, CAST(row_number() OVER (PARTITION BY t ORDER BY n) AS INTEGER) AS stmt_ord, action,
  CASE WHEN action IN ('CreateTable', 'SetTableComment') THEN '' ELSE 'ALTER TABLE `lake`.`sales`.`' || t || '` ' END || tail AS statement
FROM plan JOIN depth USING (t)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        planned_star, observed_columns, diff_columns, diff_tags, diff_properties, diff_keys, diff_layout, required_features, policy_failures, plan_order, plan_statements,
        widening_matrix, info_primary_key, info_foreign_keys, info_inbound_keys, fk_verdicts, blocked_tables, dependency_depth, run_report, rows_after_rename, rows_after_add,
        rows_after_drop, rows_after_widen, rows_after_all, schema_conformed_read)
} | estate.QUERIES

_K = "WITH RECURSIVE "
ORACLES: dict[str, str] = {
    "plan_order": _PLAN_ORDER,
    "planned_star": _PLANNED_STAR.replace("WITH keys", "WITH RECURSIVE keys", 1),
    "observed_columns": _described(STAR),
    "diff_columns": _diff_columns_sql(),
    "policy_failures": f"SELECT table_id, 'ColumnSpellingMustMatchCatalog' AS rule, subject FROM ({_diff_columns_sql()}) WHERE action = 'ColumnCaseDrift'",
    "run_report": f"WITH {_relation_sql('t', DESIRED, 'tables')}, bad AS (SELECT DISTINCT table_id FROM ({_diff_columns_sql()}) WHERE action = 'ColumnCaseDrift') "
        "SELECT table_id, CASE WHEN table_id IN (FROM bad) THEN 'PLANNING_FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN table_id IN (FROM bad) THEN 'not planned' ELSE 'planned' END AS change_state FROM t_tables",
    "diff_tags": "WITH " + _relation_sql("d", DESIRED, "tags") + ", " + _relation_sql("o", _seeded(), "tags") + _DIFF_TAGS,
    "diff_properties": "WITH " + _relation_sql("d", DESIRED, "properties") + ", " + _relation_sql("o", _seeded(), "tables", "properties") + _DIFF_PROPERTIES,
    "diff_keys": "WITH " + _relation_sql("d", DESIRED, "primary_keys", "foreign_keys") + ", " + _relation_sql("o", _seeded(), "tables", "primary_keys", "foreign_keys") + _DIFF_KEYS,
    "diff_layout": "WITH " + _relation_sql("d", DESIRED, "layout") + ", " + _relation_sql("o", _seeded(), "tables", "layout") + _DIFF_LAYOUT,
    "required_features": "SELECT DISTINCT 'lake.sales.' || table_name AS table_id, 'timestampNtz' AS feature FROM (" + _described(STAR) + ") WHERE type_sql = 'TIMESTAMP_NTZ'",
    "plan_statements": _creates_sql(),
    "widening_matrix": _WIDENING,
    "info_primary_key": _INFO + "SELECT tc.constraint_name, column_name, ordinal_position FROM tc JOIN kcu USING (constraint_catalog, constraint_schema, constraint_name) WHERE tc.table_name = 'account' AND constraint_type = 'PRIMARY KEY'",
    "info_foreign_keys": _INFO + "SELECT rc.constraint_name, f.column_name AS local_column, p.table_name AS referenced_table, p.column_name AS referenced_column, f.ordinal_position FROM rc "
        "JOIN kcu f ON f.constraint_name = rc.constraint_name JOIN kcu p ON p.constraint_name = rc.unique_constraint_name AND p.ordinal_position = f.position_in_unique_constraint WHERE f.table_name = 'payment'",
    "info_inbound_keys": _INFO + "SELECT rc.constraint_name, c.table_catalog AS referencing_catalog, c.table_schema AS referencing_schema, c.table_name AS referencing_table FROM rc "
        "JOIN tc u ON u.constraint_name = rc.unique_constraint_name AND u.constraint_type = 'PRIMARY KEY' JOIN tc c ON c.constraint_name = rc.constraint_name WHERE u.table_name = 'account'",
    "fk_verdicts": "WITH " + _relation_sql("d", _graph(), "tables", "columns", "primary_keys", "foreign_keys") + _FK_VERDICTS,
    "blocked_tables": _K + _relation_sql("d", _graph(), "foreign_keys") + _BLOCKED,
    "dependency_depth": _K + _relation_sql("d", _graph(), "tables", "foreign_keys") + _DEPTH,
    "rows_after_rename": "SELECT l_orderkey, l_linenumber AS line_no FROM lineitem",
    "rows_after_add": "SELECT l_orderkey, l_linenumber, CAST(NULL AS VARCHAR) AS note FROM lineitem",
    "rows_after_drop": "SELECT l_orderkey, l_partkey FROM lineitem",
    "rows_after_widen": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem",
    "rows_after_all": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS extra FROM lineitem",
    "schema_conformed_read": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
} | estate.ORACLES
