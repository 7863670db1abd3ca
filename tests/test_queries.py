"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare, duck
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    found = compare(spark, con, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert found in ("", "EMPTY"), found


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES)
