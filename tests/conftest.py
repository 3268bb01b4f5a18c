import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rosterkit.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8, app_name="rosterkit-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rosterkit-tests-"))
    yield s


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
