import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from adperf.session import get_session

    s = get_session(
        app="adperf-tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={"spark.driver.memory": "8g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="adperf-test-")


def raw_rows(spark, rows):
    """Build a raw fact frame from tuples in REQUIRED_COLUMNS order."""
    from adperf.schema import RAW_SCHEMA

    return spark.createDataFrame(rows, RAW_SCHEMA)
