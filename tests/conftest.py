import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from incidentlab.session import get_session
    s = get_session("local[4]", shuffle_partitions=8,
                    conf={"spark.sql.session.timeZone": "UTC"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    # a fresh folder per test; never cleared by the tests
    return tempfile.mkdtemp(prefix="incidentlab-test-")
