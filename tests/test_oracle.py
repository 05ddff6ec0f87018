"""Every registered query against its SQL in an independent engine."""

import importlib.util
import os
import pathlib

import duckdb
import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in sorted(pathlib.Path(SF_DIR).glob("*.parquet")):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(check.oracle_sql()))
def test_matches_sql(spark, con, name):
    note, _ = check.compare(spark, con, SF_DIR, name)
    assert note.startswith("ok") and "types" not in note, note


@pytest.mark.parametrize("name", sorted(set(check.queries()) - set(check.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert check.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["record_id", "split", "y", "s", "s_unweighted"]
    assert df.count() == 1000
