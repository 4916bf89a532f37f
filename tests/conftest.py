import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.folders import ensure_folder  # noqa: E402
from loanloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, **{"spark.sql.shuffle.partitions": "4"})
    ensure_folder(session)
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Rows as a DataFrame: make("a int, b string", (1, "x"), (2, None))."""
    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)
    return build
