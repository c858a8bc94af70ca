import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from coursemetrics.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app="coursemetrics-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="coursemetrics-tests-"))  # tests only
    yield s
    s.stop()
