import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    assert difference(entry.queries()[name](spark, SF_DIR), oracle.sql(entry.oracle_sql()[name])) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_answers(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry_has_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0
