import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, memory="6g")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def make(spark):
    """make("a string, b int", (1, 2), ...) -> DataFrame"""
    return lambda schema, *rows: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
