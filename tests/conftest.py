import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from reelforge.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def scratch(tmp_path):
    # Tests only: a private folder (jobs on a cluster take paths from their caller).
    return str(tmp_path)
