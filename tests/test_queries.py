"""Every registered query with SQL gives the rows of its SQL; the command line plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(map(repr, (tuple(r) for r in found.select(columns).toPandas().astype(object).itertuples(index=False))))
    want = sorted(map(repr, (tuple(r) for r in duck.sql(entry.oracle_sql()[name]).df()[columns].astype(object).itertuples(index=False))))
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["table_ord", "table_id", "stmt_ord", "action", "statement"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tablewright.cli import main

    (tmp_path / "mytables.py").write_text("from tablewright.schema import *\nprint('noise')\nTABLES = [Table('c', 's', 't', [Column('id', Integer())])]\nEMPTY = []\n")
    (tmp_path / "store/c/s").mkdir(parents=True)
    monkeypatch.chdir(tmp_path)
    assert main(["plan", "mytables:TABLES", "--store", str(tmp_path / "store")]) == 0
    out = capsys.readouterr().out
    assert "CREATE TABLE `c`.`s`.`t` (`id` INT) USING delta;" in out and "noise" not in out and out.startswith("TARGET")
    assert main(["plan", "mytables:TABLES", "--store", str(tmp_path / "none")]) == 1
    assert main(["plan", "mytables:EMPTY"]) == 2 and main(["plan", "nothing"]) == 2 and main([]) == 2
