"""Every registered query on the smallest data, against its SQL where it has one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__  # noqa: E402
from tools.check_oracle import database, differences  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    return database(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert differences(spark, duck, FOLDER, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).collect()


def test_entry(spark):
    result = __spark_entry__.entry(spark)
    assert "bleu" in result.columns and result.count() > 0
