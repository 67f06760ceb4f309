import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from furlong.session import get_session
    s = get_session("local[*]", app="furlong-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    """A fresh folder under the session's checkpoint dir for written tables."""
    from furlong.session import scratch_path
    import uuid
    return scratch_path(spark, "tests", uuid.uuid4().hex[:12])


@pytest.fixture()
def local_dir():
    return tempfile.mkdtemp(prefix="furlong-test-")
