"""Every registered query against its SQL counterpart, over the whole small tables."""

import os

import pytest

pytest.importorskip("duckdb")

import __spark_entry__ as entry
from emberwatch.catalog import check

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    ok, note = check.check(spark, con, name, SF, entry.queries(), entry.oracle_sql())
    assert ok, note


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
