import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_TINY = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerlane.session import build_session
    shared = tempfile.mkdtemp(prefix="ledgerlane-shared-")   # local mode: one machine is the cluster
    s = build_session("local[*]", shuffle_partitions=8, app="ledgerlane-tests",
                      extra={"spark.checkpoint.dir": f"file://{shared}"})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="ledgerlane-test-")
