"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from stratafolio.session import get_session

    session = get_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
