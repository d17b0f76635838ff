import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trendloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Small DataFrame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
