import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from seaplate.session import local_session, remove_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    remove_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("SEAPLATE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
