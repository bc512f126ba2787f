import os

import pytest

from spanloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPANLOOM_DRIVER_MEMORY", "6g")
    s = build_session("tests", cores=min(8, os.cpu_count() or 4), partitions=4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    """The smallest tables, where they are."""
    path = os.environ.get("SPANLOOM_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path
