"""Every registered query against its SQL on the smallest tables."""

import os

import oracle_check
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_check.entry.queries()))
def test_query(spark, con, name):
    assert oracle_check.compare(spark, con, name, SF) is None


def test_entry_has_rows(spark):
    assert oracle_check.entry.entry(spark).count() == 10


def test_every_sql_belongs_to_a_query():
    assert set(oracle_check.entry.oracle_sql()) <= set(oracle_check.entry.queries())
