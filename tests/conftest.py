import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohorta.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="cohorta-tests")
    if not s.sparkContext.getCheckpointDir():
        d = tempfile.mkdtemp(prefix="cohorta-test-ckpt-")
        s.sparkContext.setCheckpointDir(d)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="cohorta-t-")
