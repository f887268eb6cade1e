"""Every query of the key-value engine against its DuckDB SQL."""

import glob
import os

import duckdb
import pytest

from kvloom.plans import catalog
from kvloom.plans.commands import Session, holds, inside_target, parse_shell

FOLDER = "/root/testdata/sf0.001"
#: These run a whole session; parts of one have a test below.
SLOW = {"q33_commands", "q34_load_and_compact"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_a_load_restores_a_deleted_namespace_and_a_compaction_restarts_counts(spark):
    session = Session(spark)
    replies = [session.run(line) for line in ("SET u/a 1", "SAVE u s1", "DEL u", "SET u/b 9", "LOAD s1", "GET u/a", "GET u/b", "GET RANGE a z")]
    assert replies[-3:] == ["1", "ERROR: Key not found.", "--- RANGE MATCHES ---\r\n[u] => root/u\r\n" + "-" * 22]
    shell = Session(spark, parse_shell)
    for line in ("put a 1", "put a 2", "del b", "compact", "put c 3"):
        assert shell.run(line) == ""
    assert "Live Keys     : 2\n   Total Entries : 2\n   Waste Ratio   : 0.00%" in shell.run("stats")
    assert inside_target("u/a", "root/u") and inside_target("root/u", "root/u", True) and not inside_target("users2/a", "root/users")
    assert holds("u", "root/u/x") and not holds("u/y", "root/u")


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    result = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    order = [result.columns.index(c) for c in df.columns]
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
