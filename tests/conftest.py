import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from augmill.session import local_session

    s = local_session(cpus="*", partitions=8, app="augmill-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMOKE
