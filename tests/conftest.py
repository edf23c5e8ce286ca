import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from glossmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression over literal inputs, one result per input."""

    def run(expression, values, schema="v string"):
        rows = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
        return [row[0] for row in rows.coalesce(1).select(expression).collect()]

    return run
